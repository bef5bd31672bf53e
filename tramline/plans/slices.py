"""Slice answers and the quality report: stored trajectories to events and rollups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import audit, buses, detect, fleet, rollups
from ..session import materialise


@dataclass
class SliceView:
    points: DataFrame
    events: DataFrame
    totals: DataFrame


def slice_view(
    traj: DataFrame,
    route_stops: DataFrame,
    route_id: str | None = None,
    service_date: Column | None = None,
    direction_id: int | None = None,
    stale_s: float | None = None,
    **thresholds,
) -> SliceView:
    """Buses, events and totals of one slice, or of every slice when nothing is fixed.

    The grouped points feed several detectors, so they are written once to the shared folder
    and read from there.
    """
    rows = traj
    for name, value in (("route_id", route_id), ("direction_id", direction_id)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    if service_date is not None:
        rows = rows.filter(F.col("service_date") == service_date)
    cut = {} if stale_s is None else {"stale_s": stale_s}
    points = materialise(buses.group_into_buses(rows, route_stops, **cut), "points")
    events = materialise(detect.detect_all(points, **thresholds), "events")
    return SliceView(points, events, rollups.slice_totals(events, points))


def slice_analytics(view: SliceView, route_stops: DataFrame, crowd_pct: float = 100.0) -> dict[str, DataFrame]:
    return {
        "hourly_counts": rollups.hourly_anomaly_counts(view.events, view.points),
        "stop_counts": rollups.stop_anomaly_counts(view.events, route_stops, view.points),
        "hourly_speed": rollups.hourly_moving_speed(view.points),
        "hourly_allocation": rollups.hourly_time_allocation(view.points, view.events, crowd_pct),
    }


def quality_report(vp: DataFrame, logs: DataFrame, traj: DataFrame, columns: list[str]) -> DataFrame:
    """Key figures of every stage as ``section, item, value`` rows; each is a small aggregate."""
    flat = lambda df, section, item: df.unpivot([item] if item else [], [c for c in df.columns if c != item], "measure", "value").select(
        F.lit(section).alias("section"),
        (F.concat_ws(".", F.col(item).cast("string"), "measure") if item else F.col("measure")).alias("item"), F.col("value").cast("double").alias("value"))
    dbl = lambda df, keep: df.select(*keep, *[F.col(c).cast("double").alias(c) for c in df.columns if c not in keep])
    parts = [
        flat(dbl(audit.feed_health(audit.hourly_feed_health(logs)), ["feed_name"]), "feed_health", "feed_name"),
        flat(dbl(audit.field_availability(vp, columns), ["field"]), "availability", "field"),
        flat(dbl(audit.clock_skew_profile(vp), []), "clock_skew", None),
        flat(dbl(audit.duplicate_keys(vp, ["vehicle_id", "vehicle_timestamp"]), []), "duplicates", None),
        flat(dbl(audit.cadence_gaps(vp), []), "cadence", None),
        flat(dbl(fleet.consecutive_dup_rate(logs), ["feed_name"]), "repeat_polls", "feed_name"),
        flat(dbl(audit.speed_bands(traj), []), "speed", None),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
