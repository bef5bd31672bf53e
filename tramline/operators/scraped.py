"""Cleaning of scraped trip paths: text fields, direction of travel, reversal splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values

TRIP = ["route_folder", "route_date", "trip_folder"]


def reformat_time_column(df: DataFrame) -> DataFrame:
    """A bracketed list of times means the vehicle stood: the last time counts and the row's
    speed and distance become zero."""
    many = values.is_bracketed(F.col("time_val"))
    return df.withColumns(
        {
            "time_val": values.last_bracketed(F.col("time_val")),
            "speed": F.when(many, "0km/h").otherwise(F.col("speed")),
            "distance": F.when(many, "0m").otherwise(F.col("distance")),
        }
    )


def direction_step(df: DataFrame) -> DataFrame:
    """+1 or -1 by the next distance; an equal one repeats the row before; the last row copies
    its predecessor. A window holds one trip file."""
    w = Window.partitionBy(*TRIP).orderBy("datetime")
    nxt = F.lead("travel_distance_m").over(w)
    here = F.col("travel_distance_m")
    raw = F.when(nxt > here, 1).when(nxt < here, -1).when(nxt == here, F.lit(None))
    before_first = F.when(nxt >= here, 1).otherwise(-1)
    stepped = df.withColumns({"_raw": raw, "_equal": nxt == here, "_own": before_first, "_last": nxt.isNull()})
    # an equal row takes the plain sign of the row before it (which is +1 for an equal one)
    carried = F.lag("_own").over(w)
    stepped = stepped.withColumn("_step", F.when(F.col("_equal"), carried).otherwise(F.col("_own")))
    step = F.when(F.col("_last"), F.lag("_step").over(w)).otherwise(F.col("_step"))
    return stepped.withColumn("direction_step", step).drop("_raw", "_own", "_step")


def split_at_first_reversal(stepped: DataFrame) -> DataFrame:
    """``part`` 1 up to the first change of sign and 2 after it, and whether there was one."""
    w = Window.partitionBy(*TRIP).orderBy("datetime")
    nxt = F.lead("direction_step").over(w)
    change = ~F.col("_last") & ~F.col("_equal") & ~F.col("direction_step").eqNullSafe(nxt)
    whole = Window.partitionBy(*TRIP)
    cut = F.min(F.when(F.col("_change"), F.col("datetime"))).over(whole)
    return (
        stepped.withColumn("_change", change)
        .withColumn("_cut", cut)
        .withColumns(
            {
                "multi_direction_trip": F.col("_cut").isNotNull(),
                "part": F.when(F.col("_cut").isNull() | (F.col("datetime") <= F.col("_cut")), 1).otherwise(2),
            }
        )
        .drop("_change", "_cut", "_equal", "_last")
    )


def final_direction(parts: DataFrame) -> DataFrame:
    """Sign of each part's last row."""
    last = parts.groupBy(*TRIP, "part").agg(F.max_by("direction_step", "datetime").alias("direction_sign"))
    return parts.join(last, [*TRIP, "part"])
