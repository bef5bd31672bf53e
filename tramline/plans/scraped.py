"""Scraped trip paths to cleaned, direction-split, resampled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..operators import fleet, scraped, shapes
from ..operators import trajectory as tr
from ..operators.sequence import earliest_by
from ..session import materialise


def clean_trips(raw: DataFrame, segments: DataFrame, shape_id: str, corridor_m: float = 100.0,
                start: str = "08:00:00", end: str = "23:59:59", resolution_s: int = 10) -> DataFrame:
    """``raw`` as read by ``scan_trip_path_files`` with ``time_val, distance, speed,
    time_offset, longitude, latitude``. Rows outside the corridor go, distances run along the
    chosen shape from the nearest network point, trips are cut at their first reversal."""
    timed = materialise(scraped.reformat_time_column(raw), "scraped")  # many small files, opened once
    near = materialise(shapes.nearest_among_shapes(timed, segments, corridor_m).filter("nearest_shape_id is not null"), "near")
    placed = shapes.distance_of_foot(near, segments, shape_id).withColumns(
        {
            "datetime": values.date_and_clock(F.col("route_date"), F.col("time_val")),
            "distance_m": values.distance_text_m(F.col("distance")),
            "time_offset_seconds": values.offset_text_s(F.col("time_offset")),
        }
    )
    dated = fleet.time_of_day_filter(placed.filter("datetime is not null"), "datetime", start, end)
    # one row per second of a trip file; the choice among repeats does not depend on row order
    unique = earliest_by(dated, [*scraped.TRIP, "datetime"], ["travel_distance_m", "distance", "time_offset"])
    parts = scraped.split_at_first_reversal(scraped.direction_step(unique))
    # the resampler works per instance: a trip file's part is one
    keyed = parts.withColumns(
        {
            "trip_id": F.concat_ws("/", *scraped.TRIP, F.col("part").cast("string")),
            "start_date": F.substring_index("route_date", "_", -1),
        }
    )
    speeds = tr.moving_speed(keyed.select("trip_id", "start_date", *scraped.TRIP, "part", "direction_step", "datetime",
                                          "travel_distance_m", "time_offset_seconds", "multi_direction_trip"))
    up = tr.upsample_grid(speeds, resolution_s)
    ends = scraped.final_direction(up)
    return ends.select(
        F.col("route_folder").alias("route"), F.col("route_date").alias("date"), "trip_folder", "part", "direction_sign",
        "datetime", values.round2(F.col("travel_distance_m")).alias("travel_distance_m"),
        values.round2(F.col("moving_speed_m_s")).alias("moving_speed_m_s"), "time_offset_seconds",
    )
