"""Group trajectory rows into physical runs ("buses") inside a slice.

A slice is ``(service_date, route_id, direction_id)``. A bus is one vehicle on one trip
instance, cut where it stood still for a long time. Its ``bus_id`` text sorts exactly like
(trip, start date, vehicle with null last, segment), so it serves as the order key everywhere
and the dense ``bus_index`` is only numbered when a result shows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..defaults import DEFAULTS
from ..session import cut, materialise, tasks_for
from .lookup import interval_lookup

SLICE = ["service_date", "route_id", "direction_id"]
RUN = [*SLICE, "trip_id", "start_date", "vehicle_id"]


def distance_to_stop_index(traj: DataFrame, route_stops: DataFrame) -> DataFrame:
    """Fractional stop index, linear between stops and clamped to the ends. Spans of zero
    length never match, so a shared distance takes the later stop as the search does."""
    keys = ["route_id", "direction_id"]
    w = Window.partitionBy(*keys).orderBy("stop_idx")  # one stop list
    spans = route_stops.select(
        *keys, "stop_idx", F.col("distance_m").alias("lo"), F.lead("distance_m").over(w).alias("hi")
    ).filter("hi > lo")
    ends = route_stops.groupBy(*keys).agg(
        F.min("distance_m").alias("_first"), F.max("distance_m").alias("_last"), F.count("*").alias("num_stops")
    )
    found = interval_lookup(traj, spans, keys, "travel_distance_m", ["stop_idx"], width=500.0).join(ends, keys, "left")
    d = F.col("travel_distance_m")
    inside = F.col("stop_idx") + (d - F.col("lo")) / (F.col("hi") - F.col("lo"))
    stop = (
        F.when(d <= F.col("_first"), F.lit(0.0))
        .when(d >= F.col("_last"), (F.col("num_stops") - 1).cast("double"))
        .otherwise(inside)
    )
    return found.withColumn("stop_index", stop).drop("lo", "hi", "stop_idx", "_first", "_last")


def segment_vehicle_points(
    points: DataFrame,
    stale_s: float = DEFAULTS.stale_s,
    min_displacement_m: float = DEFAULTS.min_displacement_m,
    speed_limit: float = DEFAULTS.idle_speed_m_s,
) -> DataFrame:
    """Cut each run at long stale stretches and drop ghost segments; adds ``segment``.

    One exchange: every window is keyed by the run or a finer key of it. The rows are stored and counted first, so that
    each of its tasks sorts the same number of rows however many there are.
    """
    stored = materialise(points, "resampled")
    flagged = flag_segments(cut(stored, tasks_for(stored), *RUN), stale_s, min_displacement_m, speed_limit)
    return flagged.filter("kept").drop("kept", "stale", "group_points")


def flag_segments(
    points: DataFrame,
    stale_s: float = DEFAULTS.stale_s,
    min_displacement_m: float = DEFAULTS.min_displacement_m,
    speed_limit: float = DEFAULTS.idle_speed_m_s,
) -> DataFrame:
    """As ``segment_vehicle_points`` but keeps all rows and says which would stay."""
    w = Window.partitionBy(*RUN).orderBy("datetime")
    whole = Window.partitionBy(*RUN)
    still = F.abs(F.coalesce("moving_speed_m_s", F.lit(0.0))) < speed_limit
    stretch = Window.partitionBy(*RUN, "_stretch")
    seg = Window.partitionBy(*RUN, "segment", "stale")
    seg_t = seg.orderBy("datetime")
    span = (F.max(F.unix_micros("datetime")).over(stretch) - F.min(F.unix_micros("datetime")).over(stretch)) / 1e6
    moved = F.abs(F.col("travel_distance_m") - F.lag("travel_distance_m").over(seg_t))
    return (
        points.withColumn("_still", still)
        .withColumn("_turn", F.col("_still") != F.lag("_still", 1, False).over(w))
        .withColumn("_stretch", F.sum(F.col("_turn").cast("int")).over(w))
        .withColumn("stale", F.col("_still") & (span >= stale_s))
        .withColumn("_cut", F.col("stale") & ~F.lag("stale", 1, False).over(w))
        .withColumn("segment", F.sum(F.col("_cut").cast("int")).over(w).cast("int"))
        .withColumn("group_points", F.count("*").over(whole))
        .withColumn("_moved", moved)
        .withColumn("_n", F.count("*").over(seg))
        .withColumn("_total", F.sum("_moved").over(seg))
        .withColumn(
            "kept",
            (F.col("group_points") == 1)
            | (~F.col("stale") & (F.col("_n") >= 2) & (F.col("_total") >= min_displacement_m)),
        )
        .drop("_still", "_turn", "_stretch", "_cut", "_moved", "_n", "_total")
    )


def with_bus_id(points: DataFrame) -> DataFrame:
    sep = "\u0001"
    return points.withColumn(
        "bus_id",
        F.concat_ws(
            sep,
            "trip_id",
            "start_date",
            F.coalesce("vehicle_id", F.lit("￿")),
            F.lpad(F.col("segment").cast("string"), 6, "0"),
        ),
    )


def group_into_buses(traj: DataFrame, route_stops: DataFrame, **limits) -> DataFrame:
    """Points of every surviving bus of every slice, with ``bus_id`` and ``stop_index``."""
    return with_bus_id(segment_vehicle_points(distance_to_stop_index(traj, route_stops), **limits))


def bus_numbers(points: DataFrame) -> DataFrame:
    """Dense ``bus_index`` per slice, numbered on the list of buses rather than on points."""
    w = Window.partitionBy(*SLICE).orderBy("bus_id")
    return (
        points.groupBy(*SLICE, "bus_id")
        .agg(F.count("*").alias("bus_points"))
        .withColumn("bus_index", F.row_number().over(w) - 1)
    )


def number_buses(rows: DataFrame, points: DataFrame) -> DataFrame:
    return rows.join(bus_numbers(points).drop("bus_points"), [*SLICE, "bus_id"])
