"""Static timetable bundle: CSV scans with declared columns, calendars, bundle checks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The columns used of each file of the public timetable format.
TABLES: dict[str, dict[str, str]] = {
    "trips": {"trip_id": "string", "route_id": "string", "service_id": "string", "direction_id": "int", "shape_id": "string"},
    "stops": {"stop_id": "string", "stop_name": "string", "stop_lat": "double", "stop_lon": "double"},
    "stop_times": {"trip_id": "string", "arrival_time": "string", "departure_time": "string", "stop_id": "string", "stop_sequence": "int"},
    "shapes": {"shape_id": "string", "shape_pt_lat": "double", "shape_pt_lon": "double", "shape_pt_sequence": "int"},
    "routes": {"route_id": "string", "route_short_name": "string"},
    "calendar": {"service_id": "string", "monday": "int", "tuesday": "int", "wednesday": "int", "thursday": "int",
                 "friday": "int", "saturday": "int", "sunday": "int", "start_date": "string", "end_date": "string"},
    "calendar_dates": {"service_id": "string", "date": "string", "exception_type": "int"},
    "feed_info": {"feed_version": "string", "feed_start_date": "string", "feed_end_date": "string"},
}


def _typed_empty(spark: SparkSession, table: str) -> DataFrame:
    ddl = ", ".join(f"{c} {t}" for c, t in TABLES[table].items())
    return spark.createDataFrame([], ddl)


def has_table(spark: SparkSession, folder: str, table: str) -> bool:
    try:
        spark.read.format("text").load(f"{folder}/{table}.txt").schema
        return True
    except AnalysisException:
        return False


def scan_table(spark: SparkSession, folder: str, table: str, required: bool = True) -> DataFrame:
    """The wanted columns that the file has, typed; wanted but missing ones as typed nulls.

    All columns are read as text and cast, so ids keep leading zeros and no file is scanned
    for inference (the header line alone decides which columns exist).
    """
    if not required and not has_table(spark, folder, table):
        return _typed_empty(spark, table)
    raw = spark.read.option("header", True).option("inferSchema", False).csv(f"{folder}/{table}.txt")
    cols = {c.strip().lstrip("﻿"): c for c in raw.columns}
    picked = [
        (F.col(f"`{cols[c]}`").try_cast(t) if c in cols else F.lit(None).cast(t)).alias(c)
        for c, t in TABLES[table].items()
    ]
    return raw.select(*picked)


def missing_columns(spark: SparkSession, folder: str, table: str) -> list[str]:
    raw = spark.read.option("header", True).csv(f"{folder}/{table}.txt")
    return [c for c in TABLES[table] if c not in raw.columns]


def scan_feed_info(spark: SparkSession, folder: str) -> DataFrame:
    """One row always: the first row of the file, or nulls if it is absent or empty."""
    info = scan_table(spark, folder, "feed_info", required=False).limit(1)
    one = spark.range(1).select(F.lit(1).alias("_k"))
    return one.join(info.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")


def _scan_position(df: DataFrame) -> Column:
    line = F.monotonically_increasing_id().alias("line")
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        return F.struct(line)
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), line)


def dedup_trips_keep_first(trips: DataFrame, order: str | None = None) -> DataFrame:
    """Unique trip_id, first row in file order wins. With no order column given, a row's place is its file, by path, its
    part of the file and its line; Spark itself reads large files first. A frame that is not a scan of files is taken
    in the order of its partitions."""
    rest = [c for c in trips.columns if c not in ("trip_id", order)]
    ranked = trips.withColumn("_pos", F.col(order) if order else _scan_position(trips))
    return ranked.groupBy("trip_id").agg(F.min_by(F.struct(*rest), "_pos").alias("r")).select("trip_id", "r.*")


def dropped_trip_count(trips: DataFrame) -> DataFrame:
    return trips.agg((F.count("trip_id") - F.countDistinct("trip_id")).alias("dropped"))


def scan_calendars(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, bool]:
    """Calendar, exceptions, and whether the bundle has either (unknown is not "no service")."""
    known = has_table(spark, folder, "calendar") or has_table(spark, folder, "calendar_dates")
    return (
        scan_table(spark, folder, "calendar", required=False),
        scan_table(spark, folder, "calendar_dates", required=False),
        known,
    )


def active_services(calendar: DataFrame, calendar_dates: DataFrame, dates: DataFrame) -> DataFrame:
    """Service ids per ``service_date``: weekday inside the validity, plus added, minus removed."""
    ymd = F.date_format("service_date", "yyyyMMdd")
    day = F.lower(F.date_format("service_date", "EEEE"))
    week = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    dated = dates.select("service_date").distinct().withColumns({"ymd": ymd, "day": day})
    weekly = calendar.unpivot(["service_id", "start_date", "end_date"], week, "day", "runs").filter("runs = 1")
    regular = (
        weekly.join(dated, "day")
        .filter((F.col("start_date") <= F.col("ymd")) & (F.col("end_date") >= F.col("ymd")))
        .select("service_date", "service_id")
    )
    exceptions = calendar_dates.join(dated, F.col("date") == F.col("ymd")).select("service_date", "service_id", "exception_type")
    added = exceptions.filter("exception_type = 1").select("service_date", "service_id")
    removed = exceptions.filter("exception_type = 2").select("service_date", "service_id")
    return regular.unionByName(added).distinct().join(removed.distinct(), ["service_date", "service_id"], "left_anti")


def orphan_references(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """One row: distinct child keys without a parent, and their share of distinct keys."""
    keys = child.select(F.col(key).alias("k")).filter("k is not null").distinct()
    known = parent.select(F.col(parent_key or key).alias("k")).distinct().withColumn("found", F.lit(1))
    joined = keys.join(known, "k", "left")
    n, bad = F.count("*"), F.count_if(F.col("found").isNull())
    return joined.agg(n.alias("distinct_keys"), bad.alias("orphans"),
                      F.when(n > 0, 100 * bad / n).otherwise(F.lit(0.0)).alias("orphan_pct"))


def trips_without_stop_times(trips: DataFrame, stop_times: DataFrame, tolerated_pct: float = 5.0) -> DataFrame:
    """One row if more than the tolerated share of trips has no stop times, else none."""
    out = orphan_references(trips, stop_times, "trip_id")
    return out.filter(F.col("orphan_pct") > tolerated_pct).withColumnRenamed("orphans", "uncovered_trips")


def bundle_problems(bundle: dict[str, DataFrame], missing: dict[str, list[str]] | None = None) -> DataFrame:
    """Readable problem rows: missing columns, empty tables, orphans, uncovered trips."""
    spark = next(iter(bundle.values())).sparkSession
    rows = [
        spark.range(1).select(F.lit("missing_columns").alias("problem"), F.lit(t).alias("table_name"),
                              F.lit(", ".join(cols)).alias("detail"))
        for t, cols in (missing or {}).items() if cols
    ]
    for t, df in bundle.items():
        rows.append(
            df.agg(F.count("*").alias("n")).filter("n = 0").select(
                F.lit("empty_table").alias("problem"), F.lit(t).alias("table_name"), F.lit("no rows").alias("detail")
            )
        )

    def orphans(child: str, parent: str, key: str) -> DataFrame:
        return orphan_references(bundle[child], bundle[parent], key).filter("orphans > 0").select(
            F.lit("orphan_reference").alias("problem"),
            F.lit(child).alias("table_name"),
            F.format_string("%d %s not in %s (%.1f%%)", "orphans", F.lit(key), F.lit(parent), "orphan_pct").alias("detail"),
        )

    if {"trips", "shapes"} <= bundle.keys():
        rows.append(orphans("trips", "shapes", "shape_id"))
    if {"stop_times", "stops"} <= bundle.keys():
        rows.append(orphans("stop_times", "stops", "stop_id"))
    if {"trips", "stop_times"} <= bundle.keys():
        rows.append(
            trips_without_stop_times(bundle["trips"], bundle["stop_times"]).select(
                F.lit("trips_without_stop_times").alias("problem"), F.lit("trips").alias("table_name"),
                F.format_string("%d trips (%.1f%%)", "uncovered_trips", "orphan_pct").alias("detail"),
            )
        )
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def shared_stops(stop_times: DataFrame, trip_a: str, trip_b: str) -> DataFrame:
    of = lambda t: stop_times.filter(F.col("trip_id") == t).select("stop_id")
    return of(trip_a).intersect(of(trip_b))


def trip_starts(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """First departure per trip in seconds after the service day's midnight."""
    from ..functions.times import gtfs_seconds

    first = stop_times.groupBy("trip_id").agg(F.min_by("departure_time", "stop_sequence").alias("dep"))
    starts = first.select("trip_id", gtfs_seconds(F.col("dep")).alias("start_s")).filter("start_s is not null")
    return starts.join(trips.select("trip_id", "route_id", "direction_id", "service_id"), "trip_id")


def scheduled_headway(starts: DataFrame, services: DataFrame | None, dates: DataFrame) -> DataFrame:
    """Per date: gap to the scheduled trip before on the same route and direction.

    ``services`` gives the active ids per date; None means the calendar is unknown and no
    filter applies. The first trip of a day has no headway and no row. One window partition is
    one day's trips of one route and direction.
    """
    if services is None:
        asked = dates.select(F.collect_set("service_date").alias("d")).scalar()
        day = starts.withColumn("service_date", F.explode(asked))
    else:
        day = starts.join(services, "service_id")
    w = Window.partitionBy("service_date", "route_id", "direction_id").orderBy("start_s", "trip_id")
    gap = (F.col("start_s") - F.lag("start_s").over(w)).cast("double")
    return day.withColumn("sched_headway_s", gap).filter("sched_headway_s is not null").select(
        "service_date", "route_id", "direction_id", "trip_id", "sched_headway_s"
    )


def headway_overnight_fallback(buses: DataFrame, headways: DataFrame) -> DataFrame:
    """Scheduled headway of each bus on its service date, else on the day before (trips past
    midnight), with the cause of the answer."""
    keys = ["route_id", "direction_id", "trip_id"]
    same = headways.select("service_date", *keys, F.col("sched_headway_s").alias("_same"))
    prev = headways.select(F.date_add("service_date", 1).alias("service_date"), *keys, F.col("sched_headway_s").alias("_prev"))
    joined = buses.join(same, ["service_date", *keys], "left").join(prev, ["service_date", *keys], "left")
    cause = (
        F.when(F.col("_same").isNotNull(), "ok").when(F.col("_prev").isNotNull(), "after_midnight").otherwise("unknown")
    )
    return joined.withColumns({"sched_headway_s": F.coalesce("_same", "_prev"), "cause": cause}).drop("_same", "_prev")


def observed_headway_at_stop(crossings: DataFrame, stop: int | None = None, hole_min: float = 45.0) -> DataFrame:
    """Gaps between upward passages at a stop per slice, with a flag for holes. Without a stop
    every stop is reported."""
    rows = crossings.filter("upward")
    if stop is not None:
        rows = rows.filter(F.col("stop") == stop)
    slice_ = ["service_date", "route_id", "direction_id"]
    w = Window.partitionBy(*slice_, "stop").orderBy("cross_us", "bus_id")
    gap = (F.col("cross_us") - F.lag("cross_us").over(w)) / 1e6
    return (
        rows.withColumn("gap_s", gap).filter("gap_s is not null")
        .select(*slice_, "stop", "bus_id", "cross_us", "gap_s", (F.col("gap_s") / 60 > hole_min).alias("is_hole"))
    )
