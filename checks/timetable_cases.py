"""Timetable scans, calendars, headways and bundle checks."""

from pyspark.sql import functions as F

from tramline.functions import times
from tramline.operators import buses, detect, fleet
from tramline.session import shared_dir
from tramline.sources import timetable as tt

from . import fixtures as fx
from .registry import case, r, rounded, rs
from .sql_views import VIEWS


def _csv(df, folder, name):
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.txt")


def bundle_dir(spark, d):
    """The derived timetable as CSV files, with a column nobody asked for and one missing."""
    folder = shared_dir(spark, "bundle")
    _csv(fx.trips(spark, d).withColumn("block_id", F.lit("b")).drop("user_id"), folder, "trips")
    _csv(fx.stop_times(spark, d).select("trip_id", "departure_time", "stop_id", "stop_sequence"), folder, "stop_times")
    return folder


@case("s01_scan_gtfs_table", """select trip_id, null::varchar as arrival_time, stop_id, stop_sequence, dep_s from v_stoptimes""")
def _(spark, d):
    out = tt.scan_table(spark, bundle_dir(spark, d), "stop_times")
    return rounded(out.select("trip_id", "arrival_time", "stop_id", "stop_sequence", times.gtfs_seconds(F.col("departure_time")).alias("dep_s")))


@case("s02_scan_feed_info", """select 'v' || count(*) as feed_version, strftime(min(ts), '%Y%m%d') as feed_start_date, strftime(max(ts), '%Y%m%d') as feed_end_date from events""")
def _(spark, d):
    folder = shared_dir(spark, "bundle")
    ev = fx.table(spark, d, "events")
    _csv(ev.agg(F.concat(F.lit("v"), F.count("*")).alias("feed_version"), F.date_format(F.min("ts"), "yyyyMMdd").alias("feed_start_date"),
                F.date_format(F.max("ts"), "yyyyMMdd").alias("feed_end_date")), folder, "feed_info")
    return tt.scan_feed_info(spark, folder)


@case("s03_dedup_trips_keep_first", "select 'T' || user_id as trip_id, arg_min(event_type, event_id) as event_type from events group by 1")
def _(spark, d):
    rows = fx.table(spark, d, "events").select(F.concat(F.lit("T"), "user_id").alias("trip_id"), "event_type", "event_id")
    return tt.dedup_trips_keep_first(rows, "event_id").select("trip_id", "event_type")


@case("s03_dropped_trip_count", "select count(user_id) - count(distinct user_id) as dropped from events")
def _(spark, d):
    return tt.dropped_trip_count(fx.table(spark, d, "events").withColumn("trip_id", F.col("user_id")))


def calendars(spark, d):
    """One weekly row per service in use; exceptions by order date: 5-urgent removes wk, others add sat."""
    used = fx.trips(spark, d).select("service_id").distinct()
    wk = F.col("service_id") == "wk"
    on = lambda c: F.when(c, 1).otherwise(0)
    cal = used.select(
        "service_id", *[on(wk).alias(x) for x in ("monday", "tuesday", "wednesday", "thursday", "friday")],
        on(~wk).alias("saturday"), on(~wk).alias("sunday"), F.lit("19920101").alias("start_date"), F.lit("19981231").alias("end_date"))
    o = fx.table(spark, d, "orders")
    exc = o.groupBy(F.date_format("o_orderdate", "yyyyMMdd").alias("date")).agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"), F.count("*").alias("n"))
    exc = exc.select("date", F.explode(F.array(
        F.struct(F.lit("wk").alias("service_id"), F.when(F.col("u") * 4 > F.col("n"), 2).alias("exception_type")),
        F.struct(F.lit("sat").alias("service_id"), F.when(F.col("u") * 4 > F.col("n"), 1).alias("exception_type")))).alias("e"))
    exc = exc.select("e.service_id", "date", "e.exception_type").filter("exception_type is not null")
    dates = o.select(F.to_date("o_orderdate").alias("service_date")).distinct()
    return cal, exc, dates


VIEWS["v_day"] = """select o_orderdate::date as day, count(*) filter (where o_orderpriority = '1-URGENT') * 4 > count(*) as odd from orders group by 1"""
VIEWS["v_active"] = """
select day, s.service_id from v_day, (select distinct service_id from v_trips) s
where case when s.service_id = 'sat' then odd or (isodow(day) >= 6 and strftime(day, '%Y%m%d') between '19920101' and '19981231')
  else not odd and isodow(day) <= 5 and strftime(day, '%Y%m%d') between '19920101' and '19981231' end
union select day, 'sat' from v_day where odd"""


@case("u01_active_services", "select strftime(day, '%Y%m%d') as service_date, service_id from v_active")
def _(spark, d):
    return rounded(tt.active_services(*calendars(spark, d)))


@case("s04_scan_calendars", "select service_id, count(*) as active_days from v_active group by 1")
def _(spark, d):
    folder = shared_dir(spark, "bundle")
    cal, exc, dates = calendars(spark, d)
    _csv(cal, folder, "calendar")
    _csv(exc, folder, "calendar_dates")
    c, e, known = tt.scan_calendars(spark, folder)
    assert known
    return tt.active_services(c, e, dates).groupBy("service_id").agg(F.count("*").alias("active_days"))


def _slice_services(spark, d):
    """Weekday service on the first night, every service on the second."""
    t = fx.trips(spark, d).select("service_id").distinct()
    both = t.select("service_id", F.explode(F.array(F.lit("2023-12-31").cast("date"), F.lit("2024-01-01").cast("date"))).alias("service_date"))
    return both.filter("service_date = date'2024-01-01' or service_id = 'wk'")


VIEWS["v_sched"] = """
select service_date, route_id, direction_id, trip_id, hw from (
 select x.service_date, t.route_id, t.direction_id, t.trip_id,
 (21600 + 360 * t.user_id - lag(21600 + 360 * t.user_id) over (partition by x.service_date, t.route_id, t.direction_id order by t.user_id))::double as hw
 from v_trips t, (select '20231231' as service_date union all select '20240101') x where x.service_date = '20240101' or t.service_id = 'wk')
where hw is not null"""


@case("w19_scheduled_headway", "select service_date, route_id, direction_id, trip_id, hw as sched_headway_s from v_sched")
def _(spark, d):
    starts = tt.trip_starts(fx.stop_times(spark, d), fx.trips(spark, d))
    sv = _slice_services(spark, d)
    return rounded(tt.scheduled_headway(starts, sv, sv.select("service_date")))


@case("w20_headway_overnight_fallback", """
select b.service_date, b.route_id, b.direction_id, b.trip_id, coalesce(s.hw, p.hw) as sched_headway_s,
 case when s.hw is not null then 'ok' when p.hw is not null then 'after_midnight' else 'unknown' end as cause
from (select distinct service_date, route_id, direction_id, trip_id from v_traj) b
left join v_sched s on s.service_date = b.service_date and s.route_id = b.route_id and s.direction_id = b.direction_id and s.trip_id = b.trip_id and s.service_date = '20231231'
left join v_sched p on b.service_date = '20240101' and p.service_date = '20231231' and p.route_id = b.route_id and p.direction_id = b.direction_id and p.trip_id = b.trip_id""")
def _(spark, d):
    starts = tt.trip_starts(fx.stop_times(spark, d), fx.trips(spark, d))
    sv = _slice_services(spark, d).filter("service_date = date'2023-12-31'")
    hw = tt.scheduled_headway(starts, sv, sv.select("service_date"))
    b = fx.trajectories(spark, d).select(*buses.SLICE, "trip_id").distinct()
    return rounded(tt.headway_overnight_fallback(b, hw))


@case("w21_observed_headway_at_stop", f"""
select service_date, route_id, direction_id, stop, bus_index, {rs('gap / 1e6')} as gap_s, gap / 6e7 > 5 as is_hole from (
 select *, cross_us - lag(cross_us) over (partition by service_date, route_id, direction_id, stop order by cross_us, bus_index) as gap from v_cross where upward)
where gap is not null""")
def _(spark, d):
    pts = fx.bus_points(spark, d)
    out = tt.observed_headway_at_stop(detect.stop_crossings(pts), hole_min=5.0)
    return rounded(buses.number_buses(out, pts).select(*buses.SLICE, "stop", "bus_index", "gap_s", "is_hole"))


@case("p02_parse_gtfs_time", "select event_id as id, case when user_id % 11 <> 0 then (6 + user_id % 40) * 3600 + (event_id % 60) * 60 + base % 60 end as seconds from v_base")
def _(spark, d):
    ev = fx.table(spark, d, "events").withColumn("base", F.expr("(unix_micros(cast(ts as timestamp)) - 1704067200000000) div 1440000000"))
    text = F.expr("case when user_id % 11 = 0 then 'bogus' else concat(6 + user_id % 40, ':', lpad(event_id % 60, 2, '0'), ':', lpad(base % 60, 2, '0')) end")
    return rounded(ev.select(F.col("event_id").alias("id"), times.gtfs_seconds(text).alias("seconds")))


@case("j10_orphan_references", f"""
select count(*) as distinct_keys, count(*) filter (where o_orderkey is null) as orphans, {rs('100e0 * count(*) filter (where o_orderkey is null) / count(*)')} as orphan_pct
from (select distinct l_orderkey from lineitem) left join (select o_orderkey from orders where o_orderpriority <> '1-URGENT') on l_orderkey = o_orderkey""")
def _(spark, d):
    o = fx.table(spark, d, "orders").filter("o_orderpriority <> '1-URGENT'")
    return rounded(tt.orphan_references(fx.table(spark, d, "lineitem"), o, "l_orderkey", "o_orderkey"))


@case("j11_trips_without_stop_times", f"""
select * from (select count(*) as distinct_keys, count(*) filter (where l is null) as uncovered_trips, {rs('100e0 * count(*) filter (where l is null) / count(*)')} as orphan_pct
from orders left join (select distinct l_orderkey as l from lineitem where l_returnflag = 'N') on l = o_orderkey) where orphan_pct > 5""")
def _(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("trip_id"))
    li = fx.table(spark, d, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("trip_id"))
    return rounded(tt.trips_without_stop_times(o, li))


@case("a20_bundle_problems", """
select 'orphan_reference' as problem, 'stop_times' as table_name, printf('%d stop_id not in stops (%.1f%%)', n, 100e0 * n / k) as detail
from (select count(distinct l_partkey) as k, count(distinct case when p is null then l_partkey end) as n from lineitem left join (select p_partkey as p from part where p_size <= 25) on p = l_partkey) where n > 0
union all select 'trips_without_stop_times', 'trips', printf('%d trips (%.1f%%)', n, 100e0 * n / k) from (
 select count(*) as k, count(*) filter (where l is null) as n from orders left join (select distinct l_orderkey as l from lineitem) on l = o_orderkey) where 100e0 * n / k > 5
union all select 'missing_columns', 'stops', 'stop_lat, stop_lon'
union all select 'orphan_reference', 'trips', printf('%d shape_id not in shapes (100.0%%)', count(distinct o_orderpriority)) from orders
union all select 'empty_table', 'shapes', 'no rows'""")
def _(spark, d):
    li = fx.table(spark, d, "lineitem")
    bundle = {
        "trips": fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_orderpriority").alias("shape_id")),
        "stop_times": li.select(F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("stop_id")),
        "stops": fx.table(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("stop_id")),
        "shapes": fx.table(spark, d, "region").filter("r_regionkey < 0").select(F.col("r_name").alias("shape_id")),
    }
    return tt.bundle_problems(bundle, {"stops": ["stop_lat", "stop_lon"], "trips": []})


@case("u03_shared_stops", "select stop_id from v_stoptimes where trip_id = 'T3' intersect select 'P' || (user_id % 40) from events")
def _(spark, d):
    st = fx.stop_times(spark, d).filter("trip_id = 'T3'").select("trip_id", "stop_id")
    other = fx.table(spark, d, "events").select(F.lit("X").alias("trip_id"), F.concat(F.lit("P"), F.expr("user_id % 40")).alias("stop_id"))
    return tt.shared_stops(st.unionByName(other), "T3", "X")


@case("f11_feed_covers_date", """select p_partkey as k, coalesce(a <= '19950615' and '19950615' <= b, true) as covered from (
 select l_partkey as p_partkey, strftime(min(l_shipdate), '%Y%m%d') as a, case when count(*) % 7 <> 0 then strftime(max(l_shipdate), '%Y%m%d') end as b from lineitem group by 1)""")
def _(spark, d):
    info = fx.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(
        F.date_format(F.min("l_shipdate"), "yyyyMMdd").alias("feed_start_date"),
        F.when(F.count("*") % 7 != 0, F.date_format(F.max("l_shipdate"), "yyyyMMdd")).alias("feed_end_date"))
    return fleet.feed_covers_date(info, F.lit("1995-06-15").cast("date")).select("k", "covered")
