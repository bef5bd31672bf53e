"""Hour and stop rollups of a slice's events and points. Dense axes come from ``sequence``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..defaults import DEFAULTS
from ..functions import times
from .buses import SLICE
from .detect import BUS, is_crowded

TYPES = ("bunch", "idle", "crowd")


def _hour(minute: Column) -> Column:
    return (F.floor(minute / 60) % 24).cast("int")


def _each_hour(slices: DataFrame) -> DataFrame:
    return slices.select(*SLICE).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))


def hourly_anomaly_counts(events: DataFrame, slices: DataFrame) -> DataFrame:
    """24 rows per slice with one count column per event type."""
    counts = (
        events.groupBy(*SLICE, _hour(F.col("minute_of_day")).alias("hour"))
        .pivot("type", list(TYPES))
        .count()
    )
    return _each_hour(slices).join(counts, [*SLICE, "hour"], "left").fillna(0, list(TYPES))


def stop_anomaly_counts(events: DataFrame, route_stops: DataFrame, slices: DataFrame) -> DataFrame:
    """Counts per rounded stop index (half to even), in total and by type; other stops drop."""
    per_route = route_stops.groupBy("route_id", "direction_id").agg(F.count("*").alias("_n"))
    axis = (
        slices.select(*SLICE).distinct()
        .join(per_route, ["route_id", "direction_id"])
        .withColumn("stop", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
        .drop("_n")
    )
    counts = (
        events.groupBy(*SLICE, F.rint("stop_index").cast("int").alias("stop"))
        .pivot("type", list(TYPES))
        .count()
    )
    out = axis.join(counts, [*SLICE, "stop"], "left").fillna(0, list(TYPES))
    return out.withColumn("total", sum((F.col(t) for t in TYPES), F.lit(0)))


def hourly_moving_speed(points: DataFrame) -> DataFrame:
    """Mean km/h of moving samples per local hour; null where there are none."""
    v = F.coalesce("moving_speed_m_s", F.lit(0.0))
    means = (
        points.filter(v >= DEFAULTS.idle_speed_m_s)
        .groupBy(*SLICE, _hour(times.local_minute(F.col("datetime"))).alias("hour"))
        .agg(F.avg(F.col("moving_speed_m_s") * 3.6).alias("speed_kph"))
    )
    return _each_hour(points).join(means, [*SLICE, "hour"], "left")


def near_event_flag(points: DataFrame, events: DataFrame, within_min: float = 0.5) -> DataFrame:
    """Mark points within ``within_min`` minutes (inclusive) of a bunch event of the same bus.

    Events are listed under each cell of that width they reach and gathered per cell, so a
    point meets one short array and the interval join is an equi-join. The cells of one bus
    hold at most its own events.
    """
    marks = (
        events.filter("type = 'bunch'")
        .select(*BUS, F.col("minute_of_day").alias("_m"))
        .distinct()
        .withColumn("_cell", F.explode(F.expr(
            f"sequence(floor((_m - {within_min}) / {within_min}), floor((_m + {within_min}) / {within_min}))")))
        .groupBy(*BUS, "_cell")
        .agg(F.collect_list("_m").alias("_near"))
    )
    m = times.local_minute(F.col("datetime"))
    near = F.exists("_near", lambda x: F.abs(x - F.col("minute")) <= within_min)
    return (
        points.withColumn("minute", m)
        .withColumn("_cell", F.floor(F.col("minute") / within_min))
        .join(marks, [*BUS, "_cell"], "left")
        .withColumn("near_bunch", F.coalesce(near, F.lit(False)))
        .drop("_cell", "_near")
    )


def hourly_time_allocation(points: DataFrame, events: DataFrame, crowd_pct: float = DEFAULTS.crowd_pct) -> DataFrame:
    """Share of samples per hour that are normal, idle, bunched, crowded; the first that holds
    of idle, crowd, bunch counts. One decimal, zeros for empty hours."""
    flagged = near_event_flag(points, events)
    state = (
        F.when(F.coalesce("moving_speed_m_s", F.lit(0.0)) < DEFAULTS.idle_speed_m_s, "idle")
        .when(is_crowded(crowd_pct), "crowd")
        .when(F.col("near_bunch"), "bunch")
        .otherwise("normal")
    )
    counts = (
        flagged.groupBy(*SLICE, _hour(F.col("minute")).alias("hour"), state.alias("_state"))
        .count()
        .groupBy(*SLICE, "hour")
        .pivot("_state", ["idle", "bunch", "crowd", "normal"])
        .agg(F.sum("count"))
        .fillna(0)
    )
    total = F.col("idle") + F.col("bunch") + F.col("crowd") + F.col("normal")
    raw = {s: 100 * F.col(s) / total for s in ("idle", "bunch", "crowd")}
    rest = F.greatest(F.lit(0.0), 100 - raw["idle"] - raw["bunch"] - raw["crowd"])
    one = lambda c: F.rint(c * 10) / 10
    shares = counts.select(
        *SLICE, "hour",
        one(rest).alias("normal_pct"), one(raw["idle"]).alias("idle_pct"),
        one(raw["bunch"]).alias("bunch_pct"), one(raw["crowd"]).alias("crowd_pct"),
    )
    cols = ["normal_pct", "idle_pct", "bunch_pct", "crowd_pct"]
    return _each_hour(points).join(shares, [*SLICE, "hour"], "left").fillna(0.0, cols)


def slice_totals(events: DataFrame, points: DataFrame) -> DataFrame:
    """Event totals by type and bunch method, time span and distinct vehicles per slice."""
    ev = events.groupBy(*SLICE).agg(
        F.count_if(F.col("type") == "bunch").alias("bunch"),
        F.count_if(F.col("type") == "idle").alias("idle"),
        F.count_if(F.col("type") == "crowd").alias("crowd"),
        F.count_if(F.col("method") == "time").alias("bunch_time"),
        F.count_if(F.col("method") == "distance").alias("bunch_dist"),
    )
    minute = F.rint(times.local_minute(F.col("datetime")) * 100) / 100
    per_bus = points.groupBy(*BUS).agg(
        F.min_by(minute, "datetime").alias("t0"),
        F.max_by(minute, "datetime").alias("t1"),
        F.min("vehicle_id").alias("vehicle_id"),
    )
    pts = per_bus.groupBy(*SLICE).agg(
        F.min("t0").alias("start_min"),
        F.max("t1").alias("end_min"),
        F.countDistinct("vehicle_id").alias("num_vehicles"),
    )
    return pts.join(ev, SLICE, "left").fillna(0, ["bunch", "idle", "crowd", "bunch_time", "bunch_dist"])
