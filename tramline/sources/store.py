"""Tables and files written by the pipelines.

Writers hand Spark a ``rebalance`` hint on the partition columns: files come out even, and a
partition that holds much of the data is split over several tasks instead of one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..defaults import LOCAL_ZONE
from ..functions import times
from ..session import materialise, workspace
from . import versioned


def _even(df: DataFrame, *cols: str) -> DataFrame:
    return df.hint("rebalance", *[F.col(c) for c in cols])


def write_trajectories_replace(rows: DataFrame, path: str, keys: DataFrame | None = None) -> int:
    """Delete-then-insert per trip instance on a versioned table partitioned by service date.

    ``keys`` are the recomputed instances (default: those in ``rows``); an instance that now
    gives no rows loses its old ones. Only the touched dates are read and written, and all of
    them change in one step: a reader sees the version before or the one after. Running it
    again gives the same rows. Returns the version's number.
    """
    spark = rows.sparkSession
    inst = ["trip_id", "start_date"]
    with workspace(spark):
        rows = materialise(rows, "rows")
        replaced = materialise((keys if keys is not None else rows).select(*inst).distinct(), "keys")
        # an instance's rows lie in the partition of its start date: only those dates are read
        days = F.try_to_date(F.col("start_date"), "yyyyMMdd")
        dates = replaced.select(days.alias("service_date")).union(rows.select("service_date")).distinct()
        touched = [r[0] for r in dates.collect()]  # calendar days
        return versioned.change_days(spark, path, rows.schema, touched,
                                     lambda old: old.join(replaced, inst, "left_anti").unionByName(rows.select(*old.columns)))


def read_trajectories(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The stored trajectories, of the newest version or of a given one."""
    return versioned.read_table(spark, path, version)


def append_run(spark: SparkSession, path: str, run_id: str, status: str, at: Column | None = None,
               rows_written: int | None = None, error: str | None = None, config: dict[str, str] | None = None) -> None:
    """Append one event of a run to the ledger."""
    cfg = F.create_map(*[F.lit(x) for kv in sorted((config or {}).items()) for x in kv]) if config else F.lit(None).cast("map<string,string>")
    spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(status).alias("status"),
        (at if at is not None else F.current_timestamp()).alias("at"),
        F.lit(rows_written).cast("bigint").alias("rows_written"), F.lit(error).cast("string").alias("error_message"),
        cfg.alias("config"),
    ).coalesce(1).write.mode("append").parquet(path)


def run_ledger(events: DataFrame) -> DataFrame:
    """State of every run: its start, and its latest event's outcome."""
    rank = F.when(F.col("status") == "running", 0).otherwise(1)
    return events.groupBy("run_id").agg(
        F.min("at").alias("started_at"),
        F.max(F.when(F.col("status") != "running", F.col("at"))).alias("finished_at"),
        F.max_by("status", F.struct("at", rank)).alias("status"),
        F.max("rows_written").alias("rows_written"),
        F.max_by("error_message", F.struct("at", rank)).alias("error_message"),
    )


def export_day_csv(traj: DataFrame, folder: str) -> None:
    """CSV files per route, date and direction (-1 where the direction is unknown)."""
    out = traj.withColumn("direction_id", F.coalesce("direction_id", F.lit(-1)))
    cols = ["route_id", "service_date", "direction_id"]
    _even(out, *cols).write.mode("overwrite").option("header", True).partitionBy(*cols).csv(folder)


def write_example_shards(examples: DataFrame, folder: str, manifest: DataFrame | None = None) -> None:
    """Parquet shards per date and direction, and a manifest with a count per shard."""
    cols = ["service_date", "direction_id"]
    _even(examples, *cols).write.mode("overwrite").partitionBy(*cols).parquet(f"{folder}/shards")
    counts = examples.sparkSession.read.parquet(f"{folder}/shards").groupBy(*cols).agg(F.count("*").alias("n_examples"))
    counts.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    if manifest is not None:
        manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/geometry")


def date_split(dates: DataFrame, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Chronological split over distinct dates: oldest to train, newest to test. At least one
    train date, and a validation date as soon as two dates remain. One row per date."""
    all_dates = dates.select("service_date").distinct().agg(F.sort_array(F.collect_set("service_date")).alias("d"))
    n = F.size("d")
    n_train = F.greatest(F.lit(1), F.rint(n * train).cast("int"))
    n_val = F.when(n - n_train > 1, F.greatest(F.lit(1), F.rint(n * val).cast("int"))).otherwise(0)
    return all_dates.select(n_train.alias("a"), n_val.alias("b"), F.posexplode("d").alias("i", "service_date")).select(
        "service_date",
        F.when(F.col("i") < F.col("a"), "train").when(F.col("i") < F.col("a") + F.col("b"), "val").otherwise("test").alias("split"),
    )


def scan_example_split(spark: SparkSession, folder: str, split: str, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Examples of one split; the join on the partition column prunes the other dates' files."""
    shards = spark.read.parquet(f"{folder}/shards")
    wanted = date_split(read_manifest(spark, folder), train, val)
    return shards.join(wanted.filter(F.col("split") == split).select("service_date"), "service_date")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Examples per shard."""
    return spark.read.schema("service_date date, direction_id int, n_examples bigint").json(f"{folder}/manifest")


def feature_hash(window: Column) -> Column:
    """Eight-byte hash of a feature array as hex."""
    return F.lower(F.lpad(F.hex(F.xxhash64(window)), 16, "0"))


# the record of one scored bus
SCORE_LOG = (
    "ts timestamp, bundle string, route_id string, direction_id int, service_date string, t_ref_min double, bus_id string, vehicle_id string, trip_id string, "
    "stop_idx double, forward_gap_m double, gap_closure_m_s double, max_prob double, max_prob_step int, first_alert_step int, useful_horizon_steps int, "
    "per_horizon_truncated array<double>, per_horizon_raw array<double>, feature_hash string"
)


def score_log_rows(scored: DataFrame, bundle: str, at: Column | None = None, zone: str = LOCAL_ZONE) -> DataFrame:
    """The log record of every eligible bus in ``scored`` (as by ``score_slices``): who and where, the state shown, both
    vectors (cut to the useful horizon, and as scored), and a hash of the features. ``t_ref_min`` is the minute of the day in ``zone``."""
    rows = scored.filter("eligible").withColumns({
        "ts": at if at is not None else F.current_timestamp(), "bundle": F.lit(bundle),
        "t_ref_min": times.local_minute(F.timestamp_seconds("t_ref"), zone), "per_horizon_truncated": F.col("per_horizon"), "per_horizon_raw": F.col("probs"),
        "feature_hash": feature_hash(F.col("features")),
    })
    fields = [f.strip().split(" ") for f in SCORE_LOG.split(", ")]
    return rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in fields])


def read_score_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCORE_LOG).json(folder)


def append_score_log(scored: DataFrame, folder: str) -> None:
    """JSON lines per service date; appending never rewrites earlier scores."""
    _even(scored, "service_date").write.mode("append").partitionBy("service_date").json(folder)


def scan_trip_path_files(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Scraped trip files of a route/date/trip folder tree; route and date come from the path."""
    # counted from the end: a pattern that is only tied to the end is tried at every place of every row's path
    part = lambda n: F.url_decode(F.split_part(F.col("_metadata.file_path"), F.lit("/"), F.lit(n)))
    raw = spark.read.option("header", True).schema(schema).csv(glob, recursiveFileLookup=True)
    return raw.select("*", part(-4).alias("route_folder"), part(-3).alias("route_date"), part(-2).alias("trip_folder"))


def write_direction_csv(df: DataFrame, folder: str) -> None:
    """Per route and date, the parts that end forwards and those that end backwards."""
    cols = ["route", "date", "direction_sign"]
    _even(df, *cols).write.mode("overwrite").option("header", True).partitionBy(*cols).csv(folder)


def write_report_tables(metrics: DataFrame, bins: DataFrame, folder: str, headline: DataFrame | None = None, periods: DataFrame | None = None) -> None:
    """Evaluation summary as JSON and reliability bins as CSV (already small aggregates); the headline and the periods
    beside them where given."""
    for name, table in (("metrics", metrics), ("headline", headline), ("periods", periods)):
        if table is not None:
            table.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")
    bins.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/reliability")


def flatten_slice_buses(slices: DataFrame) -> DataFrame:
    """``slices`` rows hold an array of buses with nested points and events; one row per bus."""
    keys = [c for c in slices.columns if c != "buses"]
    return slices.select(*keys, F.explode("buses").alias("b")).select(
        *keys, F.col("b.id").alias("bus_id"), "b.trip_id", "b.vehicle_id",
        F.size("b.points").alias("n_points"), F.size("b.anomalies").alias("n_anomalies"),
    )


def flatten_slice_events(slices: DataFrame) -> DataFrame:
    keys = [c for c in slices.columns if c != "buses"]
    ev = slices.select(*keys, F.explode("buses").alias("b")).select(
        *keys, F.col("b.id").alias("bus_id"), F.col("b.trip_id").alias("trip_id"), F.col("b.vehicle_id").alias("vehicle_id"),
        F.explode("b.anomalies").alias("a"),
    )
    t = F.col("a.t")
    return ev.select(
        *keys, "bus_id", "trip_id", "vehicle_id", F.col("a.type").alias("event_type"),
        F.round(t, 2).alias("minute_of_day"),
        F.concat_ws(":", F.lpad(F.floor(t / 60).cast("string"), 2, "0"), F.lpad(F.floor(t % 60).cast("string"), 2, "0")).alias("approx_time_hhmm"),
        F.round("a.d", 3).alias("stop_index"), F.col("a.method").alias("method"),
    )


def sample_per_type(events: DataFrame, keys: Sequence[str] = ("event_type", "route_id"), k: int = 10) -> DataFrame:
    """First k events per type and route for hand labelling. A grouped top-k: ranks are cut
    before the shuffle, so no group is gathered whole."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("service_date", "direction_id", "bus_id", "minute_of_day", "stop_index")
    return events.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
