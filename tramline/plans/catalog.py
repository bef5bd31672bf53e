"""The route catalog kept beside the stored trajectories, brought up to date for changed dates only."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DateType, IntegerType, LongType, StringType, StructType

from ..operators import fleet
from ..sources import versioned

SCHEMA = StructType().add("route_id", StringType()).add("direction_id", IntegerType()).add("service_date", DateType()).add("n", LongType())


def refresh_route_catalog(spark: SparkSession, path: str, rollup: str) -> list[str]:
    """Recounts the dates of the table at ``path`` that changed since the last refresh; returns them.

    The rollup holds instances per route, direction and date. Its manifest notes which write of the table each date was
    counted from, so a date whose files are the same is not read, and a date that left the table leaves the rollup.
    """
    source = versioned.manifest(spark, path)
    now = {} if source is None else source["days"]
    held = versioned.manifest(spark, rollup)
    before = {} if held is None else held["notes"].get("counted", {})
    touched = sorted(d for d in {*now, *before} if now.get(d) != before.get(d))
    if touched or held is None:
        days = [None if d == versioned.NO_DAY else date.fromisoformat(d) for d in touched]

        def recount(old: DataFrame) -> DataFrame:
            if source is None:
                return old.limit(0)
            return fleet.instances_by_route_and_date(versioned.read_days(spark, path, source, touched))

        versioned.change_days(spark, rollup, SCHEMA, days, recount, notes={"counted": now})
    return touched


def route_catalog(spark: SparkSession, rollup: str) -> DataFrame:
    """One row per route and direction, from the rollup alone."""
    return fleet.catalog_of_counts(versioned.read_table(spark, rollup))
