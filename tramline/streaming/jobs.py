"""Structured Streaming jobs: the batch operators on micro-batches.

Every ``foreachBatch`` writer is safe to run twice for the same batch id: it overwrites that
batch's own folder, or replaces by key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import fleet, scoring
from ..operators import trajectory as tr
from ..plans import forecasting, trajectories
from ..session import materialise, workspace
from ..sources import feeds, store

# Seconds between polls of each feed.
POLL_SECONDS = {"vehicle_positions": 20, "trip_updates": 30, "subway_trip_updates": 60, "trip_modifications": 300}


def _batch_path(root: str, table: str, batch_id: int) -> str:
    return f"{root}/{table}/batch={batch_id}"


def ingest_batch(polls: DataFrame, batch_id: int, root: str, routes: Sequence[str] | None = None) -> None:
    """One micro-batch of polls into the append tables, each batch in its own folder (a replay
    overwrites it), split by ``fetched_date`` for the readers' partition filters."""
    polls.persist()
    ents = feeds.entities(polls).persist()  # payloads are parsed once
    tables = {
        "fetch_logs": feeds.fetch_log_rows(polls),
        "snapshots": feeds.snapshot_rows(polls),
        "vehicle_positions": feeds.vehicle_rows(ents, routes),
        "trip_updates": feeds.trip_update_rows(ents, routes),
        "trip_modifications": feeds.trip_modification_rows(ents),
    }
    try:
        for name, rows in tables.items():
            dated = rows.withColumn("fetched_date", F.to_date("fetched_at"))
            dated.write.mode("overwrite").partitionBy("fetched_date").parquet(_batch_path(root, name, batch_id))
    finally:
        ents.unpersist()
        polls.unpersist()


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
           seconds: int | None = None) -> StreamingQuery:
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if seconds is None else w.trigger(processingTime=f"{seconds} seconds")
    return w.start()


def ingest_stream(polls: DataFrame, root: str, checkpoint: str, routes: Sequence[str] | None = None,
                  feed: str | None = None) -> StreamingQuery:
    """Continuous ingest. With a feed name the query runs at that feed's interval on its rows;
    without one, everything that is there is taken once."""
    rows = polls if feed is None else polls.filter(F.col("feed_name") == feed)
    return _start(rows, lambda df, i: ingest_batch(df, i, root, routes), checkpoint, seconds=POLL_SECONDS.get(feed) if feed else None)


def changed_instances(vp: DataFrame, since: Column | None = None, route_id: str | None = None) -> DataFrame:
    """Trip instances with a row newer than the cutoff (or any row of a micro-batch)."""
    keyed = tr.with_instance(vp)
    if since is not None:
        keyed = keyed.filter(F.col("fetched_at") > since)
    if route_id is not None:
        keyed = keyed.filter(F.col("route_id") == route_id)
    return keyed.select("trip_id", "start_date").distinct()


def cold_start_cutoff(now: Column, interval_s: int) -> Column:
    """First cutoff of a refresh without a checkpoint: two intervals back."""
    return F.timestamp_micros(F.unix_micros(now) - 2 * interval_s * 1_000_000)


def refresh_batch(batch: DataFrame, history: DataFrame, trips: DataFrame, shape_points: DataFrame, path: str, **options) -> None:
    """Recompute the whole of every instance the batch touches and replace its stored rows.

    The history is first cut to the fetch windows of the touched service dates, literals that
    prune its partitions. An instance whose date is no date has no trajectory and reads nothing.
    """
    with workspace(batch.sparkSession):
        keys = materialise(changed_instances(batch), "keys")
        day = F.try_to_date(F.col("start_date"), "yyyyMMdd")
        days = [r.day for r in keys.select(day.alias("day")).distinct().collect() if r.day is not None]  # calendar days
        keyed = tr.with_instance(fleet.fetched_for(history, days)).join(keys, ["trip_id", "start_date"], "left_semi")
        rows = keyed.withColumn("start_date", F.col("feed_start_date")).select(*history.columns)
        built = trajectories.build_trajectories(rows, trips, shape_points, **options)
        store.write_trajectories_replace(built, path, keys)


def incremental_refresh(vp_stream: DataFrame, read_history: Callable[[], DataFrame], trips: DataFrame, shape_points: DataFrame,
                        path: str, checkpoint: str, seconds: int | None = None, **options) -> StreamingQuery:
    """Refresh stored trajectories as positions arrive; ``read_history`` reads the append table."""

    def write(df: DataFrame, batch_id: int) -> None:
        refresh_batch(df, read_history(), trips, shape_points, path, **options)

    return _start(vp_stream, write, checkpoint, seconds=seconds)


def with_late_slack(stream: DataFrame, ts: str = "vehicle_timestamp", slack: str = "6 hours") -> DataFrame:
    """Vehicle clocks may lag their fetch by hours; state is kept that long."""
    return stream.withWatermark(ts, slack)


def stream_dedup(stream: DataFrame, slack: str = "6 hours") -> DataFrame:
    """Exact repeats of (trip, date, time) within the slack; the refresh makes the final choice."""
    keyed = tr.with_instance(stream).filter("datetime is not null").withWatermark("datetime", slack)
    return keyed.dropDuplicatesWithinWatermark(["trip_id", "start_date", "datetime"])


def live_latest_state(stream: DataFrame) -> DataFrame:
    """Newest position per vehicle; the state is one row per vehicle."""
    rest = [c for c in stream.columns if c != "vehicle_id"]
    rows = stream.filter("vehicle_id is not null")
    return rows.groupBy("vehicle_id").agg(F.max_by(F.struct(*rest), F.struct("fetched_at", "id")).alias("r")).select("vehicle_id", "r.*")


def rolling_feed_health(log_stream: DataFrame, size: str = "1 hour", slide: str = "1 minute", slack: str = "10 minutes") -> DataFrame:
    """Success rate per feed over a sliding hour."""
    return log_stream.withWatermark("fetched_at", slack).groupBy(F.window("fetched_at", size, slide), "feed_name").agg(
        F.count("*").alias("fetches"), F.count_if("success").alias("successes"),
    ).select(F.col("window.end").alias("until"), "feed_name", "fetches", "successes", (F.col("successes") / F.col("fetches")).alias("success_rate"))


def per_minute_stream(log_stream: DataFrame, slack: str = "10 minutes") -> DataFrame:
    return log_stream.withWatermark("fetched_at", slack).groupBy(F.window("fetched_at", "1 minute"), "success").agg(
        F.count("*").alias("rows")).select(F.col("window.start").alias("minute"), "success", "rows")


def vehicle_sessions(stream: DataFrame, gap: str = "20 minutes", slack: str = "6 hours") -> DataFrame:
    """Runs of a vehicle's pings separated by silence.

    In ``append`` mode a session is emitted once, when the watermark (newest ping less ``slack``) passes its end, and its
    state is freed then: the state holds the open sessions only, however long the stream runs.
    """
    rows = stream.filter("vehicle_timestamp is not null").withWatermark("vehicle_timestamp", slack)
    return rows.groupBy(F.session_window("vehicle_timestamp", gap), "vehicle_id").agg(F.count("*").alias("pings")).select(
        "vehicle_id", F.col("session_window.start").alias("first_seen"), F.col("session_window.end").alias("closed_at"), "pings")


def session_end_mark(pings: DataFrame, gap: str = "20 minutes", slack: str = "6 hours") -> DataFrame:
    """One ping of no vehicle that closes a feed that has ended: so late that the watermark passes the end of every session of
    ``pings``. Its own session stays open and is never emitted."""
    late = F.expr(f"max(vehicle_timestamp) + interval {gap} + interval {slack} + interval 1 second")
    return pings.agg(late.alias("vehicle_timestamp")).select(F.lit(None).cast("string").alias("vehicle_id"), "vehicle_timestamp")


def keep_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Keep an aggregate as a table: each trigger writes the rows that changed to the batch's own
    folder. ``update`` lets the watermark free closed windows; ``append`` writes each row once, when it is final (sessions)."""
    return _start(stream, lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}"), checkpoint, mode)


def read_latest(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """The table that ``keep_table`` holds: per key the row of the newest batch that changed it;
    without keys every row, which is the answer in ``append`` mode."""
    every = spark.read.option("basePath", path).parquet(path)
    if not keys:
        return every.drop("batch")
    rest = [c for c in every.columns if c not in (*keys, "batch")]
    newest = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return newest.select(*keys, "_row.*")


def score_stream(point_stream: DataFrame, read_points: Callable[[DataFrame], DataFrame], model: forecasting.Forecaster, path: str,
                 checkpoint: str) -> StreamingQuery:
    """Score, per micro-batch, every slice it touches at the slice's newest time.

    ``read_points`` returns the bus points of those slices from the stored trajectories, so a
    bus's history is read, not held in state.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        with workspace(df.sparkSession):
            refs = df.groupBy("service_date", "route_id", "direction_id").agg(F.max(F.unix_seconds("datetime")).alias("t_ref"))
            scored = forecasting.score_slices(read_points(refs), refs, model)
            scored.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(point_stream, write, checkpoint)


def drift_stream(feature_stream: DataFrame, path: str, checkpoint: str, column: str = "features") -> StreamingQuery:
    """Distribution of every feature per micro-batch."""

    def write(df: DataFrame, batch_id: int) -> None:
        with workspace(df.sparkSession):
            scoring.channel_drift(df, column).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(feature_stream, write, checkpoint)
