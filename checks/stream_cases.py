"""Streaming jobs fed in several micro-batches; results must equal the batch answer."""

import math

from pyspark.sql import functions as F

from tramline.functions import times
from tramline.operators import buses, examples as ex, scoring as sc
from tramline.operators.sequence import cumulative_by_value
from tramline.plans import forecasting as fc
from tramline.session import materialise, shared_dir
from tramline.sources import store
from tramline.streaming import jobs

from . import fixtures as fx
from .learn_cases import _forecaster, _wide, scores
from .fleet_cases import _LATEST
from .registry import ORACLES, case, r, rounded, rs
from .shape_cases import _chain
from .source_cases import polls
from .sql_views import VIEWS

PARTS = 3


def land(df, name, parts=PARTS, rows_a_file=200_000):
    """Write a frame as files and read them back as a stream, in ``parts`` triggers. More rows make more files, not larger ones."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    each = max(1, math.ceil(df.count() / parts / rows_a_file))  # files of a trigger
    df.repartition(parts * each).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).parquet(path)


def land_in_order(df, column, name, parts=PARTS, last=None):
    """As ``land``, the files in order of a column, nulls first: no row is later than the watermark allows. Equal values stay
    together; ranks come from running sums per value range, not from a window over the table. ``last`` is landed after the rest."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    at = F.unix_micros(column) if dict(df.dtypes)[column] == "timestamp" else F.col(column)
    rows = materialise(df.withColumn("_at", at), "ordered")  # the fixture's rows, once
    total, nulls = rows.count(), rows.filter("_at is null").count()
    ranks = cumulative_by_value(rows.filter("_at is not null"), [], "_at", {"n": F.lit(1)})
    place = ranks.select("_at", F.expr(f"({nulls} + cum_n - n) * {parts} div {max(1, total)}").alias("_part"))
    rows = materialise(rows.join(place, "_at", "left").withColumn("_part", F.coalesce("_part", F.lit(0))).drop("_at"), "placed")
    for k in range(parts):
        rows.filter(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(path)
    if last is not None:
        last.select(*df.columns).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@case("st01_ingest_stream", """select 'fetch_logs' as table_name, count(*) as rows from v_poll union all select 'snapshots', count(*) from v_poll where poll_id % 13 <> 0 and poll_id % 17 <> 0
 union all select 'vehicle_positions', count(*) from v_ent where event_type in ('view', 'click', 'error') union all select 'trip_updates', count(*) from v_ent where event_type = 'signup'
 union all select 'trip_modifications', count(*) from v_ent where event_type = 'purchase'""")
def _(spark, d):
    root = shared_dir(spark, "ingest")
    _run(jobs.ingest_stream(land(polls(spark, d), "polls", rows_a_file=20_000), root, shared_dir(spark, "cp")))
    parts = [spark.read.parquet(f"{root}/{t}").agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "rows")
             for t in ("fetch_logs", "snapshots", "vehicle_positions", "trip_updates", "trip_modifications")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@case("st02_changed_instances", "select distinct trip_id, start_date from v_vp where fetched_s > 1704067200 + 7200")
def _(spark, d):
    return jobs.changed_instances(fx.vehicle_positions(spark, d), F.timestamp_seconds(F.lit(1704067200 + 7200)))


@case("st03_incremental_refresh")
def _(spark, d):
    vp = materialise(fx.vehicle_positions(spark, d), "vp")
    trips, shape_points = materialise(fx.trips(spark, d), "trips"), materialise(fx.shape_points(spark, d), "shapes")
    path = shared_dir(spark, "trajectories")
    _run(jobs.incremental_refresh(land(vp, "vp", 2), lambda: vp, trips, shape_points, path, shared_dir(spark, "cp")))
    return rounded(store.read_trajectories(spark, path).groupBy("trip_id", "start_date").agg(F.count("*").alias("rows"), F.min("datetime").alias("first_t"), F.max("datetime").alias("last_t")))


ORACLES["st03_incremental_refresh"] = _chain("select trip_id, start_date, count(*) as rows, min(g) as first_t, max(g) as last_t from fin group by 1, 2")


@case("st04_tick_service_dates", """select event_id as id, case when hour(ts) < 1 then strftime(ts::date - 1, '%Y%m%d') || ',' || strftime(ts, '%Y%m%d') else strftime(ts, '%Y%m%d') end as dates
 from (select event_id, ts - interval 5 hour as ts from events)""")
def _(spark, d):
    ev = fx.table(spark, d, "events")
    dates = times.tick_service_dates(F.col("ts").cast("timestamp"))
    return ev.select(F.col("event_id").alias("id"), F.array_join(F.transform(dates, lambda x: F.date_format(x, "yyyyMMdd")), ",").alias("dates"))


@case("st05_cold_start_lookback", "select event_id as id, (epoch_us(ts) // 1000000) - 240 as cutoff from events")
def _(spark, d):
    ev = fx.table(spark, d, "events")
    return rounded(ev.select(F.col("event_id").alias("id"), jobs.cold_start_cutoff(F.col("ts").cast("timestamp"), 120).alias("cutoff")))


@case("st06_late_data_slack", "select veh_s // 300 * 300 as t, count(*) as rows from v_vp where veh_s is not null group by 1")
def _(spark, d):
    vp = fx.vehicle_positions(spark, d).select("id", "vehicle_timestamp")
    s = jobs.with_late_slack(land(vp, "vp"), slack="2 days").filter("vehicle_timestamp is not null")
    agg = s.groupBy(F.window("vehicle_timestamp", "5 minutes")).agg(F.count("*").alias("rows")).select(F.col("window.start").alias("t"), "rows")
    path = shared_dir(spark, "late")
    _run(jobs.keep_table(agg, path, shared_dir(spark, "cp")))
    return rounded(jobs.read_latest(spark, path, ["t"]))


@case("st07_stream_dedup", "select distinct trip_id, start_date, dt_s as datetime from v_vp")
def _(spark, d):
    path = shared_dir(spark, "dedup")
    out = jobs.stream_dedup(land(fx.vehicle_positions(spark, d), "vp"), "2 days").select("trip_id", "start_date", "datetime")
    _run(jobs.keep_table(out, path, shared_dir(spark, "cp"), "append"))
    return rounded(spark.read.parquet(path).select("trip_id", "start_date", "datetime"))


@case("st08_live_latest_state", f"select vehicle_id, id, fetched_s as fetched_at from ({_LATEST.format(key='vehicle_id', where='')})")
def _(spark, d):
    path = shared_dir(spark, "latest")
    vp = fx.vehicle_positions(spark, d).select("vehicle_id", "id", "fetched_at", "route_id")
    _run(jobs.keep_table(jobs.live_latest_state(land(vp, "vp")), path, shared_dir(spark, "cp")))
    return rounded(jobs.read_latest(spark, path, ["vehicle_id"]).select("vehicle_id", "id", "fetched_at"))


@case("st09_rolling_feed_health", f"""select k.k * 1800 as until, feed_name, count(*) as fetches, count(*) filter (where success) as successes, {rs('count(*) filter (where success) / count(*)')} as success_rate
 from v_log, lateral (select unnest(generate_series(t // 1800 + 1, t // 1800 + 2)) as k) k group by 1, 2""")
def _(spark, d):
    path = shared_dir(spark, "health")
    logs = fx.fetch_logs(spark, d).select("fetched_at", "feed_name", "success")
    _run(jobs.keep_table(jobs.rolling_feed_health(land(logs, "logs"), "1 hour", "30 minutes", "60 days"), path, shared_dir(spark, "cp")))
    return rounded(jobs.read_latest(spark, path, ["until", "feed_name"]))


@case("st09_per_minute_stream", "select us // 60000000 * 60 as minute, success, count(*) as rows from v_log group by 1, 2")
def _(spark, d):
    path = shared_dir(spark, "minutes")
    logs = fx.fetch_logs(spark, d).select("fetched_at", "success")
    _run(jobs.keep_table(jobs.per_minute_stream(land(logs, "logs"), "60 days"), path, shared_dir(spark, "cp")))
    return rounded(jobs.read_latest(spark, path, ["minute", "success"]))


@case("st10_vehicle_sessions", """select vehicle_id, min(veh_s) as first_seen, max(veh_s) + 60 as closed_at, count(*) as pings from (
 select *, sum(brk) over (partition by vehicle_id order by veh_s, id) as s from (
  select *, (coalesce(veh_s - lag(veh_s) over (partition by vehicle_id order by veh_s, id), 61) > 60)::int as brk from v_vp where veh_s is not null)) group by vehicle_id, s""")
def _(spark, d):
    """Every session: a mark at the end of the feed lets the watermark pass the last ones too."""
    path = shared_dir(spark, "sessions")
    vp = fx.vehicle_positions(spark, d).select("vehicle_id", "vehicle_timestamp")
    gap, slack = "60 seconds", "10 minutes"
    stream = land_in_order(vp, "vehicle_timestamp", "vp", last=jobs.session_end_mark(vp, gap, slack))
    _run(jobs.keep_table(jobs.vehicle_sessions(stream, gap, slack), path, shared_dir(spark, "cp"), "append"))
    return rounded(jobs.read_latest(spark, path))


@case("st11_rolling_window_scoring")
def _(spark, d):
    pts = materialise(fx.bus_points(spark, d), "points")
    model = _forecaster(spark, d)
    path = shared_dir(spark, "scored")
    read = lambda refs: pts.join(refs.select(*buses.SLICE), buses.SLICE, "left_semi")
    _run(jobs.score_stream(land(pts.select(*buses.SLICE, "datetime"), "points", 2), read, model, path, shared_dir(spark, "cp")))
    out = spark.read.parquet(path)
    return rounded(out.groupBy(*buses.SLICE).agg(F.count("*").alias("scored_rows"), F.count_if("eligible").alias("eligible")))


@case("st12_drift_snapshots", f"""select b.b as batch, h - 1 as feature_idx, {rs('avg(p)')} as mean, {rs('stddev_pop(p)')} as std, {rs('quantile_cont(p, 0.01)')} as p01, {rs('quantile_cont(p, 0.99)')} as p99
from v_score join (select example_id, (row_number() over (order by example_id) - 1) * 3 // count(*) over () as b from (select distinct example_id from v_score)) b using (example_id) group by 1, 2""")
def _(spark, d):
    path = shared_dir(spark, "drift")
    wide = _wide(spark, d)
    _run(jobs.drift_stream(land_in_order(wide, "example_id", "features"), path, shared_dir(spark, "cp"), "probs"))
    return rounded(spark.read.option("basePath", path).parquet(path))
