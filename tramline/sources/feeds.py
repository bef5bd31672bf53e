"""Landed feed polls to typed rows: positions, trip updates, detours, logs and snapshots.

A poll is one fetch attempt: ``poll_id, feed_name, feed_url, fetched_at, http_status,
duration_ms, payload, error_type, error_message``; ``payload`` is the decoded feed message as
JSON text, null when the fetch failed. The same functions serve batch and micro-batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import epoch_to_utc

# The parts of the public realtime format that are kept.
TRIP = "trip_id string, route_id string, direction_id int, start_date string, start_time string, schedule_relationship string"
EVENT = "struct<time: bigint, delay: int, uncertainty: int>"
ENTITY = f"""
id string,
vehicle struct<trip: struct<{TRIP.replace(' string', ': string').replace(' int', ': int')}>,
  vehicle: struct<id: string, label: string>,
  position: struct<latitude: double, longitude: double, bearing: float, odometer: double, speed: float>,
  timestamp: bigint, current_status: string, current_stop_sequence: int, stop_id: string,
  occupancy_status: string, occupancy_percentage: int, congestion_level: string>,
trip_update struct<trip: struct<{TRIP.replace(' string', ': string').replace(' int', ': int')}>,
  vehicle: struct<id: string, label: string>, timestamp: bigint, delay: int,
  stop_time_update: array<struct<stop_sequence: int, stop_id: string, schedule_relationship: string, arrival: {EVENT}, departure: {EVENT}>>>,
trip_modifications struct<selected_trips: array<struct<trip_ids: array<string>>>, service_dates: array<string>,
  start_times: array<string>, modifications: array<string>>,
shape struct<shape_id: string, encoded_polyline: string>
"""
MESSAGE = "header struct<gtfs_realtime_version: string, incrementality: string, timestamp: bigint>, entity array<string>"

FEED_POSITIONS = "vehicle_positions"
FEED_TRIP_UPDATES = "trip_updates"
FEED_SUBWAY_TRIP_UPDATES = "subway_trip_updates"
FEED_TRIP_MODIFICATIONS = "trip_modifications"
MESSAGE_LIMIT = 8000


def _set(c: str) -> Column:
    """A text field; the format's empty string means unset."""
    return F.nullif(F.col(c), F.lit(""))


def parsed_polls(polls: DataFrame) -> DataFrame:
    return polls.withColumn("msg", F.from_json("payload", MESSAGE))


def feed_header(polls: DataFrame) -> DataFrame:
    """Version, incrementality, header time and entity count of each poll."""
    h = "msg.header"
    return parsed_polls(polls).select(
        "poll_id", "feed_name", "fetched_at",
        _set(f"{h}.gtfs_realtime_version").alias("gtfs_realtime_version"),
        F.col(f"{h}.incrementality").alias("incrementality"),
        epoch_to_utc(F.col(f"{h}.timestamp")).alias("feed_header_timestamp"),
        F.coalesce(F.size("msg.entity"), F.lit(0)).alias("entity_count"),
    )


def entities(polls: DataFrame) -> DataFrame:
    """One row per feed entity with its raw text and typed form. The id is the poll id and the
    position in the poll, so a replayed batch gives the same ids."""
    each = parsed_polls(polls).select(
        "poll_id", "feed_name", "fetched_at",
        epoch_to_utc(F.col("msg.header.timestamp")).alias("feed_header_timestamp"),
        F.posexplode("msg.entity").alias("pos", "raw_entity"),
    )
    return each.select(
        (F.shiftleft(F.col("poll_id").cast("bigint"), 20) + F.col("pos")).alias("id"),
        F.col("poll_id").alias("snapshot_id"),
        "feed_name", "fetched_at", "feed_header_timestamp", "raw_entity",
        F.from_json("raw_entity", ENTITY).alias("e"),
    ).withColumn("entity_id", F.coalesce("e.id", F.lit("")))


def route_allowlist_filter(rows: DataFrame, routes: Sequence[str] | DataFrame | None,
                           route: str = "route_id", exempt_feeds: Sequence[str] = (FEED_SUBWAY_TRIP_UPDATES,)) -> DataFrame:
    """Keep listed routes; an empty list keeps all. Rows without a route go when a list is
    given. Feeds whose routes are not in this name space (subway) are never filtered."""
    exempt = F.col("feed_name").isin(list(exempt_feeds)) if "feed_name" in rows.columns and exempt_feeds else F.lit(False)
    if routes is None:
        return rows
    if isinstance(routes, DataFrame):
        listed = routes.select(F.col(routes.columns[0]).alias("_r")).distinct().withColumn("_in", F.lit(True))
        size = listed.agg(F.count("*")).scalar()
        j = rows.join(listed, rows[route] == F.col("_r"), "left")
        return j.filter(exempt | F.coalesce("_in", F.lit(False)) | (size == 0)).drop("_r", "_in")
    return rows if not routes else rows.filter(exempt | F.coalesce(F.col(route).isin(list(routes)), F.lit(False)))


def _trip_columns(base: str) -> list[Column]:
    t = f"{base}.trip"
    return [
        _set(f"{t}.trip_id").alias("trip_id"), _set(f"{t}.route_id").alias("route_id"),
        F.col(f"{t}.direction_id").cast("short").alias("direction_id"),
        _set(f"{t}.start_date").alias("start_date"), _set(f"{t}.start_time").alias("start_time"),
        F.col(f"{t}.schedule_relationship").alias("schedule_relationship"),
        _set(f"{base}.vehicle.id").alias("vehicle_id"), _set(f"{base}.vehicle.label").alias("vehicle_label"),
    ]


def vehicle_rows(ents: DataFrame, routes: Sequence[str] | None = None) -> DataFrame:
    """Entities that carry a vehicle as typed position rows."""
    v = "e.vehicle"
    rows = ents.filter("e.vehicle is not null").select(
        "id", "snapshot_id", "feed_name", "fetched_at", "feed_header_timestamp", "entity_id",
        epoch_to_utc(F.col(f"{v}.timestamp")).alias("vehicle_timestamp"),
        *_trip_columns(v),
        F.col(f"{v}.position.latitude").alias("latitude"), F.col(f"{v}.position.longitude").alias("longitude"),
        F.col(f"{v}.position.bearing").alias("bearing"), F.col(f"{v}.position.odometer").alias("odometer"),
        F.col(f"{v}.position.speed").alias("speed_mps"),
        F.col(f"{v}.current_status").alias("current_status"),
        F.col(f"{v}.current_stop_sequence").alias("current_stop_sequence"),
        _set(f"{v}.stop_id").alias("stop_id"),
        F.col(f"{v}.occupancy_status").alias("occupancy_status"),
        F.col(f"{v}.occupancy_percentage").cast("short").alias("occupancy_percentage"),
        F.col(f"{v}.congestion_level").alias("congestion_level"),
        "raw_entity",
    )
    return route_allowlist_filter(rows, routes)


def trip_update_rows(ents: DataFrame, routes: Sequence[str] | None = None) -> DataFrame:
    """Entities that carry a prediction, with the stop list nested and counted."""
    u = "e.trip_update"
    stops = F.transform(
        F.coalesce(f"{u}.stop_time_update", F.expr("array()").cast(
            f"array<struct<stop_sequence: int, stop_id: string, schedule_relationship: string, arrival: {EVENT}, departure: {EVENT}>>")),
        lambda s: F.struct(
            s["stop_sequence"].alias("stop_sequence"), F.nullif(s["stop_id"], F.lit("")).alias("stop_id"),
            s["schedule_relationship"].alias("schedule_relationship"), s["arrival"].alias("arrival"), s["departure"].alias("departure"),
        ),
    )
    rows = ents.filter("e.trip_update is not null").select(
        "id", "snapshot_id", "feed_name", "fetched_at", "feed_header_timestamp", "entity_id",
        epoch_to_utc(F.col(f"{u}.timestamp")).alias("trip_update_timestamp"),
        F.col(f"{u}.delay").alias("delay_seconds"),
        *_trip_columns(u),
        F.size(stops).alias("stop_time_update_count"),
        stops.alias("stop_time_updates"),
    )
    return route_allowlist_filter(rows, routes)


def trip_modification_rows(ents: DataFrame) -> DataFrame:
    """Detours and their replacement shapes, told apart by kind; other entities are skipped."""
    m = "e.trip_modifications"
    detour = F.col(m).isNotNull()
    return ents.filter(detour | F.col("e.shape").isNotNull()).select(
        "id", "snapshot_id", "fetched_at", "feed_header_timestamp", "entity_id",
        F.when(detour, "trip_modifications").otherwise("shape").alias("entity_kind"),
        F.when(detour, F.flatten(F.transform(f"{m}.selected_trips", lambda g: g["trip_ids"]))).alias("trip_ids"),
        F.col(f"{m}.service_dates").alias("service_dates"),
        F.col(f"{m}.start_times").alias("start_times"),
        F.when(detour, F.coalesce(F.size(f"{m}.modifications"), F.lit(0))).alias("modifications_count"),
        F.when(~detour, _set("e.shape.shape_id")).alias("shape_id"),
        F.when(~detour, _set("e.shape.encoded_polyline")).alias("encoded_polyline"),
        "raw_entity",
    )


def stop_events(trip_updates: DataFrame) -> DataFrame:
    """One row per predicted stop with arrival and departure as timestamps."""
    return trip_updates.select(
        "id", "trip_id", F.explode("stop_time_updates").alias("s")
    ).select(
        "id", "trip_id", "s.stop_sequence", "s.stop_id",
        epoch_to_utc(F.col("s.arrival.time")).alias("arrival"), epoch_to_utc(F.col("s.departure.time")).alias("departure"),
        F.col("s.arrival.delay").alias("arrival_delay"),
    )


def fetch_log_rows(polls: DataFrame) -> DataFrame:
    """One log row per attempt. A payload that does not decode is a failure of its own kind."""
    p = parsed_polls(polls)
    broken = F.col("payload").isNotNull() & F.col("msg.header").isNull()
    ok = F.col("payload").isNotNull() & ~broken
    return p.select(
        F.col("poll_id").alias("id"), "feed_name", "feed_url", "fetched_at", "http_status", ok.alias("success"),
        F.when(F.col("payload").isNotNull(), F.col("duration_ms")).alias("duration_ms"),
        F.octet_length("payload").alias("response_bytes"),
        F.when(ok, epoch_to_utc(F.col("msg.header.timestamp"))).alias("feed_header_timestamp"),
        F.when(ok, F.coalesce(F.size("msg.entity"), F.lit(0))).alias("entity_count"),
        F.when(broken, "ParseError").when(~ok, F.col("error_type")).alias("error_type"),
        F.left(F.when(broken, "payload is not a feed message").when(~ok, F.col("error_message")), F.lit(MESSAGE_LIMIT)).alias("error_message"),
    )


def snapshot_rows(polls: DataFrame) -> DataFrame:
    """One row per successful poll with the hash of its bytes. Equal hashes are kept: every
    poll is an observation."""
    p = parsed_polls(polls).filter("msg.header is not null")
    return p.select(
        F.col("poll_id").alias("id"), F.col("poll_id").alias("fetch_log_id"), "feed_name", "fetched_at",
        epoch_to_utc(F.col("msg.header.timestamp")).alias("feed_header_timestamp"),
        _set("msg.header.gtfs_realtime_version").alias("gtfs_realtime_version"),
        F.col("msg.header.incrementality").alias("incrementality"),
        F.sha2(F.col("payload").cast("binary"), 256).alias("content_sha256"),
    )
