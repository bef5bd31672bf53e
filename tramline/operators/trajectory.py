"""From raw pings to a resampled distance-along-route table.

A trip instance is ``(trip_id, start_date)``. After ``dedup_instance_times`` it holds one row
per timestamp, and feed timestamps are whole seconds, so an instance is bounded by the seconds
of its service day and its fetch slack. The windows below rely on that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..defaults import DEFAULTS, LOCAL_ZONE
from ..functions import times, values
from ..session import materialise
from .sequence import earliest_by, latest_by

INSTANCE = ["trip_id", "start_date"]

FINAL_COLUMNS = [
    "trip_id", "start_date", "service_date", "route_id", "direction_id", "shape_id", "vehicle_id",
    "datetime", "time_offset_seconds", "travel_distance_m", "moving_speed_m_s", "observed",
    "occupancy_status", "source_vehicle_position_id",
]


def with_instance(vp: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Key pings by trip instance; what the feed said stays in ``feed_start_date``."""
    eff = times.effective_start_date(F.col("start_date"), F.col("vehicle_timestamp"), F.col("fetched_at"), zone)
    return vp.filter("trip_id is not null").withColumns(
        {
            "feed_start_date": F.col("start_date"),
            "start_date": eff,
            "datetime": F.coalesce("vehicle_timestamp", "fetched_at"),
        }
    )


def within_fetch_slack(keyed: DataFrame, slack_hours: int = DEFAULTS.fetch_slack_hours, zone: str = LOCAL_ZONE) -> DataFrame:
    """Rows fetched between the slack before an instance's service day and the slack after it.
    Later echoes of the same trip id and date are not part of the run. Rows with a date that is
    no date pass here and are dropped with their instance later."""
    midnight = F.to_utc_timestamp(F.try_to_timestamp("start_date", F.lit("yyyyMMdd")), zone)
    next_day = F.to_utc_timestamp(F.try_to_timestamp("start_date", F.lit("yyyyMMdd")) + F.make_dt_interval(F.lit(1)), zone)
    slack = F.make_dt_interval(F.lit(0), F.lit(slack_hours))
    inside = (F.col("fetched_at") >= midnight - slack) & (F.col("fetched_at") < next_day + slack)
    return keyed.filter(F.coalesce(inside, F.lit(True)))


def drop_null_positions(vp: DataFrame) -> DataFrame:
    return vp.dropna(subset=["latitude", "longitude"])


def dedup_instance_times(pings: DataFrame, per_vehicle: bool = False, id_col: str = "id") -> DataFrame:
    """Keep the highest id at each timestamp of an instance (or of a vehicle in it)."""
    keys = [*INSTANCE, *(["vehicle_id"] if per_vehicle else []), "datetime"]
    return latest_by(pings, keys, [id_col])


def attach_static_trip(pings: DataFrame, trips: DataFrame) -> DataFrame:
    """Shape, static route and static direction by trip; a null direction is filled. The small
    side is broadcast only if Spark's size limit allows it."""
    static = trips.select(
        "trip_id",
        F.col("shape_id"),
        F.col("route_id").alias("static_route_id"),
        F.col("direction_id").alias("static_direction_id"),
    )
    joined = pings.join(static, "trip_id", "left")
    return joined.withColumn("direction_id", F.coalesce("direction_id", "static_direction_id"))


def instance_routes(pings: DataFrame) -> DataFrame:
    """First non-null realtime route of each instance in time order."""
    known = pings.filter("route_id is not null").select(*INSTANCE, "datetime", "id", "route_id")
    first = earliest_by(known, INSTANCE, ["datetime", "id"])
    return first.select(*INSTANCE, F.col("route_id").alias("realtime_route_id"))


def resolve_trip_kind(pings: DataFrame, trips: DataFrame) -> DataFrame:
    """Per instance: does the timetable agree on the route (match, mismatch) or not know it."""
    static = trips.select("trip_id", F.col("route_id").alias("static_route_id"))
    kind = (
        F.when(F.col("static_route_id").isNull() | F.col("realtime_route_id").isNull(), "none")
        .when(F.col("static_route_id") == F.col("realtime_route_id"), "match")
        .otherwise("mismatch")
    )
    return instance_routes(pings).join(static, "trip_id", "left").withColumn("kind", kind)


def route_mismatch_guard(pings: DataFrame, trips: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Drop instances whose timetable route contradicts the realtime one.

    Only the aggregated list of contradicting instances is joined back. ``seen`` gives the raw
    pings the realtime route is read from, so that ``pings`` may already be deduplicated: the
    join then moves one row per timestamp, never the raw copies of a hot instance.
    """
    bad = resolve_trip_kind(pings if seen is None else seen, trips).filter("kind = 'mismatch'").select(*INSTANCE)
    return pings.join(bad, INSTANCE, "left_anti")


def with_start_offset(pings: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Scheduled start from the first point of the instance and seconds since then. The feed's
    own date is needed: where it sends none the offset is null."""
    w = Window.partitionBy(*INSTANCE).orderBy("datetime", "id")
    head = F.first(F.struct("feed_start_date", "start_time")).over(w)
    start = times.trip_start_utc(F.col("_head.feed_start_date"), F.col("_head.start_time"), zone)
    return (
        pings.withColumn("_head", head)
        .withColumn("trip_start_datetime", start)
        .withColumn(
            "time_offset_seconds",
            times.time_offset_seconds(F.col("datetime"), F.col("trip_start_datetime")),
        )
        .drop("_head")
    )


def teleport_filter(points: DataFrame, max_speed_m_s: float | None = DEFAULTS.max_speed_m_s) -> DataFrame:
    """Greedy forward filter: keep a point if the speed from the last kept one is plausible.

    Up to an instance's first implausible step every point is kept and is the next one's anchor, so a window settles
    those, and instances without such a step never leave the JVM. From that step on the anchor makes it a fold: the
    doubtful rest is partitioned by instance and sorted by Spark, and each task walks its Arrow batches with the last
    anchor in hand, starting from the point before the step. No instance is held whole. Null means the default, zero
    or less disables.
    """
    limit = DEFAULTS.max_speed_m_s if max_speed_m_s is None else float(max_speed_m_s)
    if limit <= 0:
        return points
    w = Window.partitionBy(*INSTANCE).orderBy("_us")
    t, d = F.col("_us") / 1e6, F.col("travel_distance_m")
    gap, moved = t - F.lag(t).over(w), F.abs(d - F.lag(d).over(w))
    odd = F.lag("_us").over(w).isNotNull() & ~F.coalesce((gap > 0) & (moved <= limit * gap), F.lit(False))
    marked = points.withColumn("_us", F.unix_micros("datetime")).withColumn("_odd", odd)
    marked = marked.withColumn("_doubt", F.max("_odd").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    anchor = F.struct(t.alias("t"), d.cast("double").alias("d"))
    marked = marked.withColumn("_anchor", F.last(F.when(~F.col("_doubt"), anchor), ignorenulls=True).over(w))
    marked = materialise(marked.drop("_odd"), "marked")  # both parts read it; what made the points runs once
    sure = marked.filter("not _doubt").select(*points.columns)
    doubtful = (
        marked.filter("_doubt").select(*points.columns, "_us", F.col("_anchor.t").alias("_t"), F.col("_anchor.d").alias("_d"))
        .repartition(*[F.col(c) for c in INSTANCE]).sortWithinPartitions(*INSTANCE, "_us")
    )

    def walk(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        key, anchor_t, anchor_d = None, 0.0, 0.0
        for batch in batches:
            trips = batch.column("trip_id").to_pylist()
            dates = batch.column("start_date").to_pylist()
            first_t, first_d = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_t", "_d"))
            t = batch.column("_us").to_numpy(zero_copy_only=False) / 1e6
            d = batch.column("travel_distance_m").to_numpy(zero_copy_only=False)
            keep = np.zeros(len(t), dtype=bool)
            for i, here in enumerate(zip(trips, dates)):
                if here != key:
                    key, anchor_t, anchor_d = here, first_t[i], first_d[i]
                gap = t[i] - anchor_t
                if gap > 0 and abs(d[i] - anchor_d) <= limit * gap:
                    keep[i], anchor_t, anchor_d = True, t[i], d[i]
            yield batch.filter(pa.array(keep))

    return sure.unionByName(doubtful.mapInArrow(walk, doubtful.schema).select(*points.columns))


def moving_speed(points: DataFrame) -> DataFrame:
    """Speed from the previous row, stored on the arriving row; the first row gets zero."""
    w = Window.partitionBy(*INSTANCE).orderBy("datetime")
    dt = (F.unix_micros("datetime") - F.lag(F.unix_micros("datetime")).over(w)) / 1e6
    dd = F.col("travel_distance_m") - F.lag("travel_distance_m").over(w)
    return points.withColumn("moving_speed_m_s", F.coalesce(F.when(dt > 0, dd / dt), F.lit(0.0)))


def upsample_grid(
    points: DataFrame, resolution_s: int = DEFAULTS.resolution_s, max_gap_s: float | None = None
) -> DataFrame:
    """Rows at fixed time boundaries between consecutive points; source rows are not kept.

    A pair covers the multiples of the resolution from its first whole second up to, but not
    including, its last. Distance runs from the first point at the arriving speed, the other
    columns come from whichever end is nearer in distance.
    """
    carried = [c for c in points.columns if c not in (*INSTANCE, "observed", "moving_speed_m_s")]
    w = Window.partitionBy(*INSTANCE).orderBy("datetime")
    pair = points.select(
        *INSTANCE,
        F.struct(*carried).alias("a"),
        F.lead(F.struct(*carried, "moving_speed_m_s")).over(w).alias("b"),
    ).filter("b is not null")
    pair = pair.withColumns({"ta": F.unix_micros("a.datetime"), "tb": F.unix_micros("b.datetime")})
    if max_gap_s is not None:
        pair = pair.filter((F.col("tb") - F.col("ta")) / 1e6 <= F.lit(float(max_gap_s)))
    first = F.ceil(F.floor(F.col("ta") / 1e6) / resolution_s) * resolution_s
    last = F.floor(F.col("tb") / 1e6) - 1
    grid = (
        pair.withColumns({"g0": first, "g1": last})
        .filter("tb > ta and g0 <= g1")
        .withColumn("g", F.explode(F.sequence("g0", "g1", F.lit(resolution_s).cast("bigint"))))
    )
    dist = F.col("a.travel_distance_m") + (F.col("g") * 1_000_000 - F.col("ta")) / 1e6 * F.col(
        "b.moving_speed_m_s"
    )
    near_b = F.col("_d") >= (F.col("a.travel_distance_m") + F.col("b.travel_distance_m")) / 2.0
    same = [c for c in carried if c not in ("datetime", "travel_distance_m")]
    return grid.withColumn("_d", dist).select(
        *INSTANCE,
        F.timestamp_seconds("g").alias("datetime"),
        F.col("_d").alias("travel_distance_m"),
        F.col("b.moving_speed_m_s").alias("moving_speed_m_s"),
        F.lit(False).alias("observed"),
        *[F.when(near_b, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in same],
    )


def canonical_columns(traj: DataFrame) -> DataFrame:
    """Two decimals on distance and speed, columns in the stored order."""
    out = traj.withColumns(
        {
            "travel_distance_m": values.round2(F.col("travel_distance_m")),
            "moving_speed_m_s": values.round2(F.col("moving_speed_m_s")),
        }
    )
    return out.select(*[c for c in FINAL_COLUMNS if c in out.columns])


def restate_offsets(traj: DataFrame) -> DataFrame:
    """Offsets on the resampled times (``trip_start_datetime`` is the same on every row)."""
    return traj.withColumn(
        "time_offset_seconds",
        times.time_offset_seconds(F.col("datetime"), F.col("trip_start_datetime")),
    )
