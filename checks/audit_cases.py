"""Quality measurements over pings, fetch logs, trajectories and runs."""

from pyspark.sql import functions as F

from tramline.functions import values
from tramline.operators import audit, buses
from tramline.operators import trajectory as tr

from . import fixtures as fx
from .registry import case, r, rounded, rs
from .sql_views import VIEWS


def _q(col, *ps):
    return ", ".join(f"{rs(f'quantile_cont({col}, {p})')} as {n}" for n, p in ps)


@case("a32_speed_bands", f"""select count(*) as n, count(*) filter (where speed < 0) as negative, count(*) filter (where speed > 30 and speed <= 35) as band_30_35,
 count(*) filter (where speed > 35) as over_35, {_q('speed', ('p50', .5), ('p90', .9), ('p99', .99))} from v_spd""")
def _(spark, d):
    return rounded(audit.speed_bands(tr.moving_speed(tr.dedup_instance_times(fx.instances(spark, d)))))


@case("a33_synthetic_in_gaps", """
select trip_id, start_date, count(*) as pairs, sum(n)::bigint as synthetic, sum(case when dt2 - dt_s > 60 then n else 0 end)::bigint as in_holes, max(dt2 - dt_s) as longest_gap_s,
 arg_max(n, (dt2 - dt_s) * 100000 + n)::bigint as rows_in_longest
from (select *, greatest(0, ((dt2 - ((dt_s + 9) // 10) * 10) + 9) // 10) as n from v_pair where dt2 is not null) group by 1, 2""")
def _(spark, d):
    return rounded(audit.synthetic_in_gaps(tr.dedup_instance_times(fx.instances(spark, d)), hole_s=60.0))


VIEWS["v_hourly"] = """select (us // 3600000000) * 3600 as hour, feed_name, count(*) as polls, count(*) filter (where success) as ok,
 avg(duration_ms) as dur, avg(entity_count) as ents from v_log group by 1, 2"""


@case("a21_hourly_feed_health", f"select hour, feed_name, polls, ok, {rs('dur')} as avg_duration_ms, {rs('ents')} as avg_entities from v_hourly")
def _(spark, d):
    return rounded(audit.hourly_feed_health(fx.fetch_logs(spark, d)))


@case("a21_feed_health", f"""select feed_name, sum(polls)::bigint as polls, {rs('avg(ok / polls)')} as success_rate, {rs('avg(dur)')} as avg_duration_ms,
 {rs('avg(ents)')} as avg_entities from v_hourly group by 1""")
def _(spark, d):
    return rounded(audit.feed_health(audit.hourly_feed_health(fx.fetch_logs(spark, d))))


@case("j09_snapshot_log_invariant", """
select count(*) filter (where success) as ok_polls, count(s) as snaps_joined, count(*) filter (where success and s is null) as ok_without_snap,
 count(*) filter (where not success and s is not null) as fail_with_snap
from v_log left join (select id as s from v_log where duration_ms % 9 <> 0 and (success or duration_ms % 5 = 0)) on s = id""")
def _(spark, d):
    logs = fx.fetch_logs(spark, d)
    snaps = logs.filter("duration_ms % 9 <> 0 and (success or duration_ms % 5 = 0)").select(F.col("id").alias("fetch_log_id"))
    return audit.snapshot_log_invariant(logs, snaps)


_D0, _D1 = "2023-12-30", "2024-01-02"


@case("a22_daily_volume_by_route", f"""
select strftime(g.day, '%Y%m%d') as day, r.route_id, coalesce(n, 0) as n, dn is null as zero_day
from (select distinct route_id from v_vp) r, (select unnest(generate_series(date '{_D0}', date '{_D1}', interval 1 day))::date as day) g
left join (select make_timestamp(fetched_s * 1000000)::date as day, route_id, count(*) as n from v_vp group by 1, 2) c on c.day = g.day and c.route_id = r.route_id
left join (select make_timestamp(fetched_s * 1000000)::date as day, count(*) as dn from v_vp group by 1) x on x.day = g.day""")
def _(spark, d):
    return rounded(audit.daily_volume_by_route(fx.vehicle_positions(spark, d), F.lit(_D0).cast("date"), F.lit(_D1).cast("date")))


_COLS = ["vehicle_timestamp", "start_date", "speed_mps", "current_status", "occupancy_status", "vehicle_id"]
_SQLC = {"vehicle_timestamp": "veh_s", "start_date": "feed_date"}


@case("a23_field_availability", " union all ".join(
    f"select '{c}' as field, {rs(f'100e0 * count({_SQLC.get(c, c)}) / count(*)')} as pct_non_null from v_vp" for c in _COLS))
def _(spark, d):
    return rounded(audit.field_availability(fx.vehicle_positions(spark, d), _COLS))


@case("a24_clock_skew_profile", f"""select count(s) as count, {rs('avg(s)')} as mean, {rs('stddev_samp(s)')} as std, min(s) as min,
 {_q('s', ('p50', .5), ('p90', .9), ('p95', .95), ('p99', .99))}, max(s) as max from (select fetched_s - veh_s as s from v_vp)""")
def _(spark, d):
    return rounded(audit.clock_skew_profile(fx.vehicle_positions(spark, d)))


@case("a25_duplicate_keys", f"""select sum(case when veh_s is not null then n - 1 else 0 end)::bigint as duplicates, {rs('100e0 * sum(case when veh_s is not null then n - 1 else 0 end) / sum(n)')} as duplicate_pct
 from (select vehicle_id, veh_s, count(*) as n from v_vp group by 1, 2)""")
def _(spark, d):
    return rounded(audit.duplicate_keys(fx.vehicle_positions(spark, d), ["vehicle_id", "vehicle_timestamp"]))


@case("a26_vocabulary_check", """select coalesce(occupancy_status, '<NULL>') as value, count(*) as n,
 max((occupancy_status is not null and occupancy_status not in ('EMPTY', 'FULL'))::int)::bigint as unknown from v_vp group by 1""")
def _(spark, d):
    return rounded(audit.vocabulary_check(fx.vehicle_positions(spark, d), "occupancy_status", ["EMPTY", "FULL"]))


@case("u04_unknown_values", "select distinct occupancy_status as value from v_vp where occupancy_status is not null except select upper(trim(n_name)) from nation")
def _(spark, d):
    vocab = fx.table(spark, d, "nation").select(F.upper(F.trim("n_name")))
    return audit.unknown_values(fx.vehicle_positions(spark, d), "occupancy_status", vocab)


@case("w22_cadence_gaps", """
select sum(g)::bigint as gaps_in_trip, sum(v)::bigint as gaps_per_vehicle, count(*) filter (where g > 0) as trips_with_gap, count(*) as trips from (
 select trip_id, count(*) filter (where veh_s - p1 > 60) as g, count(*) filter (where veh_s - p2 > 60) as v from (
  select *, lag(veh_s) over (partition by vehicle_id, trip_id order by veh_s, id) as p1, lag(veh_s) over (partition by vehicle_id order by veh_s, id) as p2
  from (select id, vehicle_id, veh_s, trip_id || case when vt_s % 7200 < 3600 then 'a' else 'b' end as trip_id from v_vp where veh_s is not null)) group by 1)""")
def _(spark, d):
    vp = fx.vehicle_positions(spark, d)
    half = F.when((F.unix_seconds("vehicle_timestamp") % 7200) < 3600, "a").otherwise("b")
    return rounded(audit.cadence_gaps(vp.withColumn("trip_id", F.concat("trip_id", half)), 60.0, 300))


@case("a30_ghost_drop_share", """
select route_id, direction_id, sum(n)::bigint as points, sum(k)::bigint as kept, sum(n - k)::bigint as trimmed, count(*) as groups, count(*) filter (where k = 0) as ghosts, count(*) filter (where s > 1) as split
from (select route_id, direction_id, trip_id, start_date, vehicle_id, count(*) as n, count(*) filter (where kept) as k, count(distinct case when kept then segment end) as s from v_kept group by all) group by 1, 2""")
def _(spark, d):
    return rounded(audit.ghost_drop_share(buses.flag_segments(fx.trajectories(spark, d), stale_s=330.0)))


VIEWS["v_kind"] = """select trip_id, start_date, case when t.route_id is null then 'none' when t.route_id = rt then 'match' else 'mismatch' end as kind
 from (select trip_id, start_date, any_value(route_id) as rt from v_vp group by all) left join v_trips t using (trip_id)"""
VIEWS["v_kindday"] = """select start_date, count(*) as n, count(*) filter (where kind = 'match') as match, count(*) filter (where kind = 'mismatch') as mismatch,
 count(*) filter (where kind = 'none') as none, round_even(1000e0 * count(*) filter (where kind = 'match') / count(*), 0)::double / 10 as match_pct from v_kind group by 1"""


@case("a31_resolution_by_day", "select * from v_kindday")
def _(spark, d):
    return audit.resolution_by_day(tr.resolve_trip_kind(fx.instances(spark, d), fx.trips(spark, d)))


@case("a31_resolution_means", f"select case when start_date < '20240101' then 'control' else 'audit' end as \"window\", {rs('avg(match_pct)')} as mean_match_pct from v_kindday group by 1")
def _(spark, d):
    by_day = audit.resolution_by_day(tr.resolve_trip_kind(fx.instances(spark, d), fx.trips(spark, d)))
    return rounded(audit.resolution_means(by_day, F.when(F.col("start_date") < "20240101", "control").otherwise("audit")))


@case("j12_days_without_output", """select distinct strftime(ts, '%Y%m%d') as day from events
 where ts::date not in (select distinct strptime(service_date, '%Y%m%d')::date from v_traj)""")
def _(spark, d):
    ev = fx.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("fetched_at"))
    return rounded(audit.days_without_output(ev, fx.trajectories(spark, d)))


@case("a37_daily_delivery", """select service_date, route_id, count(*) as route_rows, count(distinct (trip_id, start_date, vehicle_id)) as runs,
 sum(count(*)) over (partition by service_date)::bigint as day_rows from v_traj group by 1, 2""")
def _(spark, d):
    return rounded(audit.daily_delivery(fx.trajectories(spark, d)))


@case("j13_roundtrip_diff", f"""select count(*) as matched, {rs('max(abs(a.gd - b.dist))')} as max_diff_m, count(*) filter (where abs(a.gd - b.dist) > 4e-3) as over_tolerance
from v_updist a join v_traj b on a.trip_id = b.trip_id and a.start_date = b.start_date and a.g = b.t""")
def _(spark, d):
    raw = tr.upsample_grid(tr.moving_speed(tr.dedup_instance_times(fx.instances(spark, d))).select(
        "trip_id", "start_date", "datetime", "travel_distance_m", "moving_speed_m_s"))
    return rounded(audit.roundtrip_diff(raw, fx.trajectories(spark, d), 0.004))


def runs(spark, d):
    """Orders as worker runs: status by order status, a varying duration, config with a volatile key."""
    return fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.timestamp_seconds(F.expr("unix_seconds(cast(o_orderdate as timestamp)) + o_custkey % 600")).alias("finished_at"),
        F.expr("case when o_orderstatus = 'P' then 'failed' else 'ok' end").alias("status"),
        F.col("o_custkey").alias("rows_written"),
        F.to_json(F.struct(F.col("o_orderpriority").alias("mode"), F.expr("cast(o_custkey % 3 as string)").alias("cap"),
                           F.col("o_orderkey").cast("string").alias("only_changed_since"))).alias("config_json"),
    )


@case("a34_worker_heartbeat", f"""select strftime(o_orderdate, '%Y%m%d') as day, count(*) as runs, count(*) filter (where o_orderstatus = 'P') as errors, sum(o_custkey)::bigint as rows_written,
 {rs('quantile_cont(o_custkey % 600, 0.9)')} as p90_s from orders group by 1""")
def _(spark, d):
    return rounded(audit.worker_heartbeat(runs(spark, d)))


@case("p20_stable_config_key", """select '{"cap":"' || (o_custkey % 3) || '","mode":"' || o_orderpriority || '"}' as config, count(*) as runs from orders group by 1""")
def _(spark, d):
    return audit.distinct_configs(runs(spark, d), "only_changed_since")


@case("a46_audit_windows", """
with days as (select ts::date as day, count(*) as n from events group by 1),
ext as (select min(day) as lo, max(day) as hi from days),
win as (select 'audit' as w, (hi - 7)::date as first, (hi - 1)::date as last from ext
 union all select 'control', greatest((least(date '2024-01-20', (hi - 1)::date) - 6)::date, lo), least(date '2024-01-20', (hi - 1)::date) from ext)
select w as "window", strftime(first, '%Y%m%d') as first, strftime(last, '%Y%m%d') as last, strftime(arg_max(day, n * 100000 - (day - date '2020-01-01')), '%Y%m%d') as richest_day,
 sum(n)::bigint as rows, count(*) filter (where day <= date '2024-01-20') as covered_days
from win join days on day between first and last group by 1, 2, 3""")
def _(spark, d):
    ev = fx.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("fetched_at"))
    info = fx.table(spark, d, "region").filter("r_regionkey = 0").select(F.lit("20240101").alias("feed_start_date"), F.lit("20240120").alias("feed_end_date"))
    return rounded(audit.audit_windows(ev, info))


@case("c07_quality_report", f"""
select 'duplicates' as section, 'duplicates' as item, sum(case when veh_s is not null then n - 1 else 0 end)::double as value from (select vehicle_id, veh_s, count(*) as n from v_vp group by 1, 2)
union all select 'availability', 'occupancy_status.pct_non_null', {rs('100e0 * count(occupancy_status) / count(*)')} from v_vp
union all select 'speed', 'negative', count(*) filter (where speed < 0) from v_traj""")
def _(spark, d):
    from tramline.plans import slices

    out = slices.quality_report(fx.vehicle_positions(spark, d), fx.fetch_logs(spark, d), fx.trajectories(spark, d), ["occupancy_status", "speed_mps"])
    return rounded(out.filter("(section = 'duplicates' and item = 'duplicates') or section = 'availability' and item like 'occ%' or (section = 'speed' and item = 'negative')"))
