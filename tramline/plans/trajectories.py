"""Service date(s) to stored trajectories, for every instance in one job."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..defaults import DEFAULTS
from ..operators import fleet, shapes
from ..operators import trajectory as tr
from ..session import materialise, spread, workspace
from ..sources import store


PING = ["id", "trip_id", "start_date", "feed_start_date", "start_time", "route_id", "direction_id", "vehicle_id", "datetime",
        "latitude", "longitude", "occupancy_status"]


def project_instances(
    vp: DataFrame,
    trips: DataFrame,
    segments: DataFrame,
    max_orth_m: float = DEFAULTS.max_orthogonal_m,
    per_vehicle: bool = False,
) -> DataFrame:
    """Guarded, deduplicated pings with shape, start offset and distance along the shape."""
    keyed = tr.within_fetch_slack(tr.with_instance(vp)).select(*PING)  # the grouped maximum carries whole rows: keep them narrow
    keyed = spread(keyed, "id")
    unique = tr.dedup_instance_times(tr.drop_null_positions(keyed), per_vehicle)
    guarded = tr.route_mismatch_guard(unique, trips, seen=keyed)
    placed = tr.with_start_offset(tr.attach_static_trip(guarded, trips)).withColumn(
        "service_date", F.try_to_date(F.col("start_date"), "yyyyMMdd")
    )
    return shapes.nearest_on_shape(placed.filter("service_date is not null and shape_id is not null"), segments, max_orth_m)


def build_trajectories(
    vp: DataFrame,
    trips: DataFrame,
    shape_points: DataFrame,
    service_date: str | Sequence[str] | None = None,
    route_id: str | None = None,
    resolution_s: int = DEFAULTS.resolution_s,
    max_orth_m: float = DEFAULTS.max_orthogonal_m,
    max_speed_m_s: float | None = None,
    max_gap_s: float | None = None,
) -> DataFrame:
    """The whole chain from pings to canonical trajectory rows.

    A service date, or several, adds the fetch windows as plain ranges on the partition column, then the
    exact dates. A route keeps the instances that were seen on it.
    """
    segments = shapes.shape_segments(shape_points)
    dates = [service_date] if isinstance(service_date, str) else service_date
    rows = vp if dates is None else fleet.fetched_for(vp, [date.fromisoformat(d) for d in dates])
    if route_id is not None:
        keyed = tr.with_instance(rows)
        on_route = keyed.filter(F.col("route_id") == route_id).select("trip_id", "start_date").distinct()
        rows = keyed.join(on_route, ["trip_id", "start_date"], "left_semi").withColumn(
            "start_date", F.col("feed_start_date")
        ).select(*vp.columns)
    projected = project_instances(rows, trips, segments, max_orth_m)
    if dates is not None:
        projected = projected.filter(F.col("start_date").isin([d.replace("-", "") for d in dates]))
    return finish(projected, resolution_s, max_speed_m_s, max_gap_s)


def finish(projected: DataFrame, resolution_s: int = DEFAULTS.resolution_s,
           max_speed_m_s: float | None = None, max_gap_s: float | None = None) -> DataFrame:
    """Teleport filter, speed, resampling and final columns."""
    points = projected.select(
        "trip_id", "start_date", "service_date", "route_id", "direction_id", "shape_id", "vehicle_id", "datetime",
        "trip_start_datetime", "travel_distance_m", "occupancy_status",
        F.col("id").alias("source_vehicle_position_id"),
    )
    kept = tr.moving_speed(tr.teleport_filter(points, max_speed_m_s))
    return tr.canonical_columns(tr.restate_offsets(tr.upsample_grid(kept, resolution_s, max_gap_s)))


@dataclass
class RunOutcome:
    run_id: str
    service_date: str
    instances: int
    rows_written: int
    status: str


def run_service_dates(vp: DataFrame, trips: DataFrame, shape_points: DataFrame, path: str, ledger: str, dates: Sequence[str],
                      route_id: str | None = None, changed_since: Column | None = None, feed_info: DataFrame | None = None,
                      csv_folder: str | None = None, resolution_s: int = DEFAULTS.resolution_s, max_orth_m: float = DEFAULTS.max_orthogonal_m,
                      max_speed_m_s: float | None = None, max_gap_s: float | None = None) -> list[RunOutcome]:
    """Recompute service dates (``2026-01-31``) into the stored table as one job, each a run in the ledger.

    With ``changed_since`` only instances with a row fetched after it are recomputed, each from all its rows. An
    instance that gives no rows keeps what is stored. The ledger gets ``running`` first, then ``ok`` with the date's
    rows, or ``failed`` with the message, after which the error goes on to the caller; a failed run changes no
    stored row. ``feed_info`` notes in the settings whether the timetable covers the date.
    """
    spark = vp.sparkSession
    runs = {d: uuid.uuid4().hex for d in dates}
    ymd = {d: d.replace("-", "") for d in dates}
    settings = {"route_id": route_id, "changed_only": str(changed_since is not None).lower(), "resolution_s": resolution_s, "max_orth_m": max_orth_m,
                "max_speed_m_s": max_speed_m_s, "max_gap_s": max_gap_s}
    config = {d: {"service_date": d, **{k: str(v) for k, v in settings.items() if v is not None}} for d in dates}
    if feed_info is not None:
        for d in dates:
            covered = fleet.feed_covers_date(feed_info, F.lit(d).cast("date")).agg(F.bool_and("covered")).first()[0]
            config[d]["timetable_covers_date"] = str(covered is not False).lower()
    for d in dates:
        store.append_run(spark, ledger, runs[d], "running", config=config[d])
    try:
        with workspace(spark):
            rows = vp
            if changed_since is not None:
                keyed = tr.with_instance(fleet.fetched_for(vp, [date.fromisoformat(d) for d in dates]))
                fresh = keyed.filter(F.col("start_date").isin(list(ymd.values())) & (F.col("fetched_at") > changed_since)).select("trip_id", "start_date").distinct()
                rows = keyed.join(fresh, ["trip_id", "start_date"], "left_semi").withColumn("start_date", F.col("feed_start_date")).select(*vp.columns)
            run_of = F.element_at(F.create_map(*[F.lit(x) for d in dates for x in (ymd[d], runs[d])]), F.col("start_date"))
            built = materialise(build_trajectories(rows, trips, shape_points, list(dates), route_id, resolution_s, max_orth_m, max_speed_m_s, max_gap_s)
                                .withColumn("run_id", run_of), "built")
            found = {r["start_date"]: r for r in built.groupBy("start_date").agg(
                F.count("*").alias("rows"), F.countDistinct("trip_id").alias("instances")).collect()}  # one row per date
            if found:
                store.write_trajectories_replace(built, path)
            if csv_folder is not None:
                store.export_day_csv(built.drop("run_id"), csv_folder)
    except Exception as error:
        for d in dates:
            store.append_run(spark, ledger, runs[d], "failed", rows_written=0, error=str(error)[:8000], config=config[d])
        raise
    out = []
    for d in dates:
        n = found.get(ymd[d], {"rows": 0, "instances": 0})
        store.append_run(spark, ledger, runs[d], "ok", rows_written=n["rows"], config=config[d])
        out.append(RunOutcome(runs[d], d, n["instances"], n["rows"], "ok"))
    return out
