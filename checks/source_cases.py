"""Feed ingestion, table writers and the scraped-trip chain, each written and read back."""

from pyspark.sql import functions as F

from tramline.functions import values
from tramline.operators import detect, scraped
from tramline.operators import trajectory as tr
from tramline.plans import scraped as scraped_plan
from tramline.session import shared_dir
from tramline.sources import feeds, store

from . import fixtures as fx
from .registry import case, r, rounded, rs
from .shape_cases import _segments, foot, orth, utm_sql
from .sql_views import VIEWS


def polls(spark, d):
    """Ten pings make one poll: views, clicks and errors are vehicles, signups trip updates,
    purchases detours; every thirteenth poll fails, every seventeenth is not a message."""
    p = fx.pings(spark, d)
    trip = F.struct(F.when(F.col("id") % 7 == 0, "").otherwise(F.col("trip_id")).alias("trip_id"), "route_id", "direction_id",
                    F.lit("").alias("start_date"), F.lit("07:00:00").alias("start_time"))
    vehicle = F.struct(
        trip.alias("trip"), F.struct(F.col("vehicle_id").alias("id"), F.lit("").alias("label")).alias("vehicle"),
        F.struct(F.expr("43.65e0 + dist_m / 111132e0").alias("latitude"), F.lit(-79.38).alias("longitude"), F.expr("cast(id % 20 as double)").alias("speed")).alias("position"),
        F.when(F.col("id") % 5 == 0, 0).otherwise(F.col("vt_s")).alias("timestamp"),
        F.lit("IN_TRANSIT_TO").alias("current_status"), F.lit("").alias("stop_id"))
    stop = F.transform(F.sequence(F.lit(1), (F.col("id") % 4 + 1).cast("int")), lambda i: F.struct(
        i.alias("stop_sequence"), F.concat(F.lit("P"), i).alias("stop_id"),
        F.struct((F.col("vt_s") + i * 60).alias("time"), (F.col("id") % 90).alias("delay")).alias("arrival")))
    update = F.struct(trip.alias("trip"), F.col("vt_s").alias("timestamp"),
                      F.when(F.col("id") % 3 == 0, F.col("id") % 300).alias("delay"), stop.alias("stop_time_update"))
    detour = F.struct(F.array(F.struct(F.array(F.col("trip_id"), F.lit("X")).alias("trip_ids")), F.struct(F.array(F.lit("Y")).alias("trip_ids"))).alias("selected_trips"),
                      F.array(F.lit("20240101")).alias("service_dates"), F.array("event_type").alias("modifications"))
    kind = F.col("event_type")
    entity = F.to_json(F.struct(
        F.concat(F.lit("e"), "id").alias("id"),
        F.when(kind.isin("view", "click", "error"), vehicle).alias("vehicle"),
        F.when(kind == "signup", update).alias("trip_update"),
        F.when((kind == "purchase") & (F.col("id") % 2 == 0), detour).alias("trip_modifications"),
        F.when((kind == "purchase") & (F.col("id") % 2 == 1), F.struct(F.concat(F.lit("S"), "id").alias("shape_id"), F.lit("").alias("encoded_polyline"))).alias("shape")))
    one = p.select(F.expr("id div 10").alias("poll_id"), "id", "vt_s", entity.alias("entity"))
    g = one.groupBy("poll_id").agg(F.min("vt_s").alias("t"), F.transform(F.array_sort(F.collect_list(F.struct("id", "entity"))), lambda x: x["entity"]).alias("es"))
    msg = F.concat(F.lit('{"header":{"gtfs_realtime_version":"2.0","incrementality":"FULL_DATASET","timestamp":'), F.col("t").cast("string"),
                   F.lit('},"entity":['), F.array_join("es", ","), F.lit("]}"))
    fail = F.col("poll_id") % 13 == 0
    return g.select(
        "poll_id", F.concat(F.lit("feed"), F.col("poll_id") % 2).alias("feed_name"), F.lit("u").alias("feed_url"),
        F.timestamp_seconds(F.col("t") + 1).alias("fetched_at"),
        F.when(fail, 503).otherwise(200).alias("http_status"), (F.col("poll_id") % 100).alias("duration_ms"),
        F.when(fail, F.lit(None)).when(F.col("poll_id") % 17 == 0, "not json").otherwise(msg).alias("payload"),
        F.when(fail, "HttpError").alias("error_type"), F.when(fail, F.repeat(F.lit("x"), 9000)).alias("error_message"))


VIEWS["v_ent"] = """select *, id // 10 as poll_id, count(*) over (partition by id // 10 order by id) - 1 as pos, min(vt_s) over (partition by id // 10) as header_t
 from v_ping where (id // 10) % 13 <> 0 and (id // 10) % 17 <> 0"""
VIEWS["v_poll"] = """select id // 10 as poll_id, min(vt_s) as t, count(*) as n from v_ping group by 1"""


@case("s05_ingest_vehicle_entities", f"""
select (poll_id << 20) + pos as id, poll_id as snapshot_id, header_t + 1 as fetched_at, header_t as feed_header_timestamp, 'e' || id as entity_id,
 case when id % 5 <> 0 then vt_s end as vehicle_timestamp, case when id % 7 <> 0 then trip_id end as trip_id, route_id, direction_id, null::varchar as start_date,
 '07:00:00' as start_time, vehicle_id, null::varchar as vehicle_label, {rs('43.65e0 + dist_m / 111132e0', 5)} as latitude, {rs('(id % 20)::double')} as speed_mps, 'IN_TRANSIT_TO' as current_status, null::varchar as stop_id
from v_ent where event_type in ('view', 'click', 'error')""")
def _(spark, d):
    v = feeds.vehicle_rows(feeds.entities(polls(spark, d)))
    v = v.select("id", "snapshot_id", "fetched_at", "feed_header_timestamp", "entity_id", "vehicle_timestamp", "trip_id", "route_id", "direction_id",
                 "start_date", "start_time", "vehicle_id", "vehicle_label", r("latitude", 5).alias("latitude"), "speed_mps", "current_status", "stop_id")
    return rounded(v, skip=("latitude",))


@case("s06_ingest_trip_updates", """
select (poll_id << 20) + pos as id, 'e' || id as entity_id, vt_s as trip_update_timestamp, case when id % 3 = 0 then id % 300 end as delay_seconds,
 case when id % 7 <> 0 then trip_id end as trip_id, id % 4 + 1 as stop_time_update_count from v_ent where event_type = 'signup'""")
def _(spark, d):
    return rounded(feeds.trip_update_rows(feeds.entities(polls(spark, d))).select(
        "id", "entity_id", "trip_update_timestamp", "delay_seconds", "trip_id", "stop_time_update_count"))


@case("p19_stop_events_from_json", """
select (poll_id << 20) + pos as id, k.k as stop_sequence, 'P' || k.k as stop_id, vt_s + 60 * k.k as arrival, id % 90 as arrival_delay
from v_ent, lateral (select unnest(generate_series(1, id % 4 + 1)) as k) k where event_type = 'signup'""")
def _(spark, d):
    return rounded(feeds.stop_events(feeds.trip_update_rows(feeds.entities(polls(spark, d)))).select("id", "stop_sequence", "stop_id", "arrival", "arrival_delay"))


@case("s07_ingest_trip_modifications", """
select (poll_id << 20) + pos as id, case when id % 2 = 0 then 'trip_modifications' else 'shape' end as entity_kind, case when id % 2 = 0 then trip_id || ',X,Y' end as trip_ids,
 case when id % 2 = 0 then 1 end as modifications_count, case when id % 2 = 1 then 'S' || id end as shape_id, null::varchar as encoded_polyline from v_ent where event_type = 'purchase'""")
def _(spark, d):
    m = feeds.trip_modification_rows(feeds.entities(polls(spark, d)))
    return rounded(m.select("id", "entity_kind", F.array_join("trip_ids", ",").alias("trip_ids"), "modifications_count", "shape_id", "encoded_polyline"))


@case("s08_extract_feed_header", """select poll_id, case when ok then '2.0' end as gtfs_realtime_version, case when ok then t end as feed_header_timestamp, case when ok then n else 0 end as entity_count
 from (select *, poll_id % 13 <> 0 and poll_id % 17 <> 0 as ok from v_poll)""")
def _(spark, d):
    return rounded(feeds.feed_header(polls(spark, d)).select("poll_id", "gtfs_realtime_version", "feed_header_timestamp", "entity_count"))


@case("s09_log_fetches", """select poll_id as id, poll_id % 13 <> 0 and poll_id % 17 <> 0 as success, case when poll_id % 13 <> 0 then poll_id % 100 end as duration_ms,
 case when poll_id % 13 = 0 then 'HttpError' when poll_id % 17 = 0 then 'ParseError' end as error_type, case when poll_id % 13 = 0 then 8000 when poll_id % 17 = 0 then 29 end as message_length,
 case when poll_id % 13 <> 0 and poll_id % 17 <> 0 then n end as entity_count from v_poll""")
def _(spark, d):
    out = feeds.fetch_log_rows(polls(spark, d))
    return rounded(out.select("id", "success", "duration_ms", "error_type", F.length("error_message").alias("message_length"), "entity_count"))


@case("s09_snapshots", "select poll_id as id, t as feed_header_timestamp, 64 as hash_length from v_poll where poll_id % 13 <> 0 and poll_id % 17 <> 0")
def _(spark, d):
    out = feeds.snapshot_rows(polls(spark, d))
    return rounded(out.select("id", "feed_header_timestamp", F.length("content_sha256").alias("hash_length")))


@case("s10_route_allowlist_filter", "select (poll_id << 20) + pos as id from v_ent where event_type in ('view', 'click', 'error') and route_id in ('R0', 'R3')")
def _(spark, d):
    return feeds.vehicle_rows(feeds.entities(polls(spark, d)), ["R0", "R3"]).select("id")


@case("a27_trip_update_daily", f"""select strftime(make_timestamp((header_t + 1) * 1000000), '%Y%m%d') as day, 'feed' || (poll_id % 2) as feed_name, count(*) as n, {rs('avg((id % 3 <> 0)::int)')} as delay_null_rate,
 {rs('avg(id % 4 + 1)')} as avg_stops, {rs('avg(case when id % 3 = 0 then id % 300 end)')} as avg_delay from v_ent where event_type = 'signup' group by 1, 2""")
def _(spark, d):
    from tramline.operators import audit

    return rounded(audit.trip_update_daily(feeds.trip_update_rows(feeds.entities(polls(spark, d)))))


@case("s11_write_trajectories_replace", f"""select trip_id, start_date, count(*) as rows, {rs('sum(case when route_id in (' + chr(39) + 'R1' + chr(39) + ') then dist + 1 else dist end)', 1)} as dist from v_traj group by 1, 2""")
def _(spark, d):
    """Write everything, then replace one route's instances with shifted rows, twice."""
    path = shared_dir(spark, "trajectories")
    t = fx.trajectories(spark, d)
    store.write_trajectories_replace(t, path)
    again = store.read_trajectories(spark, path).filter("route_id = 'R1'").withColumn("travel_distance_m", F.col("travel_distance_m") + 1)
    from tramline.session import materialise

    again = materialise(again, "again")
    store.write_trajectories_replace(again, path)
    store.write_trajectories_replace(again, path)
    return rounded(store.read_trajectories(spark, path).groupBy("trip_id", "start_date").agg(F.count("*").alias("rows"), F.sum("travel_distance_m").alias("dist")), 1)


@case("s12_run_ledger", """select o_orderkey::varchar as run_id, t as started_at, case when o_orderstatus <> 'O' then t + o_custkey % 600 end as finished_at,
 case o_orderstatus when 'O' then 'running' when 'P' then 'failed' else 'ok' end as status, case when o_orderstatus = 'F' then o_custkey end as rows_written,
 case when o_orderstatus = 'P' then o_orderpriority end as error_message from (select *, epoch_us(o_orderdate) // 1000000 as t from orders)""")
def _(spark, d):
    """Orders as runs: every run starts, finished ones end, partial ones fail."""
    path = shared_dir(spark, "ledger")
    o = fx.table(spark, d, "orders").withColumn("t", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    store.append_run(spark, path, "first", "running", config={"resolution": "10"})
    begun = F.struct(F.lit("running").alias("status"), F.timestamp_seconds("t").alias("at"), F.lit(None).cast("bigint").alias("rows_written"), F.lit(None).cast("string").alias("error_message"))
    ended = F.struct(
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"), F.timestamp_seconds(F.expr("t + o_custkey % 600")).alias("at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("rows_written"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("error_message"))
    steps = F.when(F.col("o_orderstatus") == "O", F.array(begun)).otherwise(F.array(begun, ended))
    log = o.select(F.col("o_orderkey").cast("string").alias("run_id"), F.explode(steps).alias("s")).select("run_id", "s.*")
    log.withColumn("config", F.lit(None).cast("map<string,string>")).write.mode("append").parquet(path)
    return rounded(store.run_ledger(spark.read.parquet(path)).filter("run_id <> 'first'"))


@case("s13_export_day_csv", "select route_id, service_date, case when route_id = 'R0' then -1 else direction_id end as direction_id, count(*) as rows from v_traj group by 1, 2, 3")
def _(spark, d):
    folder = shared_dir(spark, "csv")
    t = fx.trajectories(spark, d).withColumn("direction_id", F.when(F.col("route_id") != "R0", F.col("direction_id")))
    store.export_day_csv(t, folder)
    back = spark.read.option("header", True).option("basePath", folder).csv(folder)
    return rounded(back.groupBy("route_id", F.to_date("service_date").alias("service_date"), F.col("direction_id").cast("bigint").alias("direction_id")).agg(F.count("*").alias("rows")))


@case("u02_concat_shards", "select trip_id, count(*) as rows from v_traj group by 1")
def _(spark, d):
    folder = shared_dir(spark, "shards")
    t = fx.trajectories(spark, d)
    store.write_example_shards(t.select("service_date", "direction_id", "trip_id", "datetime"), folder)
    return spark.read.parquet(f"{folder}/shards").groupBy("trip_id").agg(F.count("*").alias("rows"))


@case("s18_write_direction_csv", "select route_id as route, service_date as date, case when direction_id = 1 then 1 else -1 end as direction_sign, count(*) as rows from v_traj group by 1, 2, 3")
def _(spark, d):
    folder = shared_dir(spark, "direction")
    t = fx.trajectories(spark, d).select(F.col("route_id").alias("route"), F.date_format("service_date", "yyyyMMdd").alias("date"),
                                         F.when(F.col("direction_id") == 1, 1).otherwise(-1).alias("direction_sign"), "trip_id", "travel_distance_m")
    store.write_direction_csv(t, folder)
    back = spark.read.option("header", True).option("inferSchema", False).csv(folder)
    return back.groupBy("route", F.col("date").cast("string").alias("date"), F.col("direction_sign").cast("bigint").alias("direction_sign")).agg(F.count("*").alias("rows"))


def _nested(spark, d):
    """Events nested per bus as a slice answer; a bus's own lists only."""
    pts = fx.bus_points(spark, d)
    ev = detect.crowd_events(pts)
    per = ev.groupBy("service_date", "route_id", "direction_id", "bus_id").agg(
        F.collect_list(F.struct(F.col("minute_of_day").alias("t"), F.col("stop_index").alias("d"), "type", "method")).alias("anomalies"))
    return per.select("service_date", "route_id", "direction_id", F.array(F.struct(
        F.col("bus_id").alias("id"), F.split("bus_id", "\u0001")[0].alias("trip_id"), F.split("bus_id", "\u0001")[2].alias("vehicle_id"),
        F.array(F.lit(0)).alias("points"), "anomalies")).alias("buses"))


@case("s20_flatten_slice_response", f"""select service_date, route_id, direction_id, type as event_type, {rs('minute_of_day', 1)} as minute_of_day,
 lpad(floor(minute_of_day / 60)::bigint::varchar, 2, '0') || ':' || lpad(floor(minute_of_day % 60)::bigint::varchar, 2, '0') as approx_time_hhmm, count(*) as n from v_crowd group by all""")
def _(spark, d):
    ev = store.flatten_slice_events(_nested(spark, d))
    return rounded(ev, 1).groupBy("service_date", "route_id", "direction_id", "event_type", "minute_of_day", "approx_time_hhmm").agg(F.count("*").alias("n"))


@case("s20_flatten_slice_buses", "select service_date, route_id, direction_id, n_anomalies, count(*) as buses from (select service_date, route_id, direction_id, bus_index, count(*) as n_anomalies from v_crowd group by all) group by all")
def _(spark, d):
    b = store.flatten_slice_buses(_nested(spark, d))
    return rounded(b.groupBy("service_date", "route_id", "direction_id", "n_anomalies").agg(F.count("*").alias("buses")))


@case("s20_sample_per_type", "select type as event_type, route_id, least(count(*), 10) as n from v_crowd group by 1, 2")
def _(spark, d):
    ev = store.sample_per_type(store.flatten_slice_events(_nested(spark, d)))
    return ev.groupBy("event_type", "route_id").agg(F.count("*").alias("n"))


# --- scraped trips --------------------------------------------------------------------------


def scraped_rows(spark, d):
    """Pings as scraped text: units, offsets, 12-hour clocks, bracketed repeats."""
    p = fx.pings(spark, d)
    local = F.from_utc_timestamp(F.timestamp_seconds(F.expr("1704110400 + (vt_s - 1704067200) % 3600")), "UTC")
    clock = F.date_format(local, "h:mm:ssa")
    return p.select(
        "id", F.col("route_id").alias("route_folder"), F.concat("route_id", F.lit("_2024-01-01")).alias("route_date"), F.col("trip_id").alias("trip_folder"),
        F.when(F.col("id") % 6 == 0, F.concat(F.lit("['1:00:00AM', '"), clock, F.lit("']"))).otherwise(clock).alias("time_val"),
        F.when(F.col("id") % 3 == 0, F.concat(F.format_string("%.1f", F.floor("value") / 10), F.lit("km")))
        .when(F.col("id") % 3 == 1, F.concat(F.floor("value").cast("string"), F.lit("m"))).otherwise(F.floor("value").cast("string")).alias("distance"),
        F.concat((F.col("id") % 90).cast("string"), F.lit("km/h")).alias("speed"),
        F.when(F.col("id") % 2 == 0, F.expr("concat(id % 70, ':', lpad(id % 60, 2, '0'))")).otherwise(F.expr("concat('1:', lpad(id % 60, 2, '0'), ':07')")).alias("time_offset"),
        F.expr("-79.38e0 + (value - 50e0) / 80400e0").alias("longitude"),
        # out and back again, so that trips reverse
        F.expr("43.65e0 + (case when dist_m > 4000 then 8000 - dist_m else dist_m end) / 111132e0").alias("latitude"),
        "value", "dist_m", "vt_s",
    )


@case("p13_parse_distance_text", f"""select id, {rs("case id % 3 when 0 then floor(value) * 100 else floor(value) end")} as meters from v_ping""")
def _(spark, d):
    return rounded(scraped_rows(spark, d).select("id", values.distance_text_m(F.col("distance")).alias("meters")))


@case("p14_parse_offset_text", "select id, case when id % 2 = 0 then (id % 70) * 60 + id % 60 else 3600 + (id % 60) * 60 + 7 end as seconds from v_ping")
def _(spark, d):
    return rounded(scraped_rows(spark, d).select("id", values.offset_text_s(F.col("time_offset")).alias("seconds")))


@case("p15_last_of_bracketed_times", """select id, case when id % 6 = 0 then '0m' else 'x' end as distance, case when id % 6 = 0 then '0km/h' else (id % 90) || 'km/h' end as speed,
 12 * 3600 + (vt_s - 1704067200) % 3600 as clock_s from v_ping""")
def _(spark, d):
    out = scraped.reformat_time_column(scraped_rows(spark, d).withColumn("distance", F.lit("x")))
    ts = F.to_timestamp(F.concat(F.lit("2024-01-01 "), "time_val"), "yyyy-MM-dd h:mm:ssa")
    return out.select("id", "distance", "speed", (F.unix_seconds(ts) - 1704067200).alias("clock_s"))


@case("p16_join_date_and_clock", "select id, 1704110400 + (vt_s - 1704067200) % 3600 as datetime from v_ping")
def _(spark, d):
    out = scraped.reformat_time_column(scraped_rows(spark, d))
    return rounded(out.select("id", values.date_and_clock(F.col("route_date"), F.col("time_val")).alias("datetime")))


def _steps(spark, d):
    rows = tr.dedup_instance_times(fx.instances(spark, d).withColumn(
        "travel_distance_m", F.floor(F.expr("case when travel_distance_m > 4000 then 8000 - travel_distance_m else travel_distance_m end") / 50) * 50.0))
    return scraped.direction_step(rows.select(
        F.col("route_id").alias("route_folder"), F.col("start_date").alias("route_date"), F.col("trip_id").alias("trip_folder"), "datetime", "travel_distance_m"))


VIEWS["v_step0"] = """select *, floor((case when dist_m > 4000 then 8000 - dist_m else dist_m end) / 50) * 50e0 as dd from v_inst"""
VIEWS["v_step1"] = """select *, lead(dd) over w as nx, case when lead(dd) over w >= dd then 1 else -1 end as s1 from v_step0 window w as (partition by trip_id, start_date order by dt_s)"""
VIEWS["v_step2"] = """select *, case when nx = dd then lag(s1) over w else s1 end as s2 from v_step1 window w as (partition by trip_id, start_date order by dt_s)"""
VIEWS["v_step3"] = """select *, case when nx is null then lag(s2) over w else s2 end as step from v_step2 window w as (partition by trip_id, start_date order by dt_s)"""
VIEWS["v_step4"] = """select *, nx is not null and nx <> dd and step is distinct from lead(step) over w as chg from v_step3 window w as (partition by trip_id, start_date order by dt_s)"""


@case("w23_direction_step", "select trip_id, start_date, dt_s as datetime, step as direction_step from v_step3")
def _(spark, d):
    return rounded(_steps(spark, d).select(F.col("trip_folder").alias("trip_id"), F.col("route_date").alias("start_date"), "datetime", "direction_step"))


@case("w24_split_at_first_reversal", """
select trip_id, start_date, dt_s as datetime, c is not null as multi_direction_trip, case when c is null or dt_s <= c then 1 else 2 end as part
from (select *, min(case when chg then dt_s end) over (partition by trip_id, start_date) as c from v_step4)""")
def _(spark, d):
    out = scraped.split_at_first_reversal(_steps(spark, d))
    return rounded(out.select(F.col("trip_folder").alias("trip_id"), F.col("route_date").alias("start_date"), "datetime", "multi_direction_trip", "part"))


def _scraped_folder(spark, d):
    folder = shared_dir(spark, "scraped")
    rows = scraped_rows(spark, d)
    cols = ["id", "time_val", "distance", "speed", "time_offset", "longitude", "latitude"]
    # one folder level per route, date and trip as the scraper leaves them; a route's trips come to one task, so that
    # its folder is made and moved once, not by every task
    plain = rows.select(F.col("route_folder").alias("r"), F.col("route_date").alias("t"), F.col("trip_folder").alias("u"), *cols)
    plain.hint("rebalance", "r", "t").write.option("header", True).partitionBy("r", "t", "u").csv(folder)
    return folder


_SCHEMA = "id long, time_val string, distance string, speed string, time_offset string, longitude double, latitude double"


def _scan(spark, d):
    raw = store.scan_trip_path_files(spark, _scraped_folder(spark, d), _SCHEMA)
    strip = lambda c: F.substring_index(c, "=", -1)
    return raw.withColumns({c: strip(F.col(c)) for c in ("route_folder", "route_date", "trip_folder")})


@case("s17_scan_trip_path_files", "select route_id as route_folder, route_id || '_2024-01-01' as route_date, trip_id as trip_folder, id from v_ping")
def _(spark, d):
    return _scan(spark, d).select("route_folder", "route_date", "trip_folder", "id")


_LX, _LY = utm_sql("longitude", "latitude")
VIEWS["v_scr"] = f"""
select *, {_LX} as x, {_LY} as y from (select route_id, trip_id, 1704110400 + (vt_s - 1704067200) % 3600 as t, -79.38e0 + (value - 50e0) / 80400e0 as longitude,
 43.65e0 + (case when dist_m > 4000 then 8000 - dist_m else dist_m end) / 111132e0 as latitude, id from v_ping)"""
VIEWS["v_scrfoot"] = f"""
select id, route_id, trip_id, t, s.x0 + {foot()} * (s.x1 - s.x0) as x, s.y0 + {foot()} * (s.y1 - s.y0) as y from v_scr p, v_polyseg s where {orth()} <= 200
qualify row_number() over (partition by id order by {orth()}, shape_id, seg_no) = 1"""
VIEWS["v_scrdist"] = f"""
select route_id, trip_id, t, min(d) as d from (select p.id, p.route_id, p.trip_id, p.t, arg_min(s.cum + {foot()} * s.len, {orth()} * 1e6 + s.seg_no * 1e-7) as d
 from v_scrfoot p, v_polyseg s where s.shape_id = 'S0' group by 1, 2, 3, 4) group by 1, 2, 3"""
VIEWS["v_scr1"] = "select *, lead(d) over w as nx, case when lead(d) over w >= d then 1 else -1 end as s1 from v_scrdist window w as (partition by route_id, trip_id order by t)"
VIEWS["v_scr2"] = "select *, case when nx = d then lag(s1) over w else s1 end as s2 from v_scr1 window w as (partition by route_id, trip_id order by t)"
VIEWS["v_scr3"] = "select *, case when nx is null then lag(s2) over w else s2 end as step from v_scr2 window w as (partition by route_id, trip_id order by t)"
VIEWS["v_scr4"] = "select *, nx is not null and nx <> d and step is distinct from lead(step) over w as chg from v_scr3 window w as (partition by route_id, trip_id order by t)"
VIEWS["v_scr5"] = """select *, case when c is null or t <= c then 1 else 2 end as part from (select *, min(case when chg then t end) over (partition by route_id, trip_id) as c from v_scr4)"""
VIEWS["v_scr6"] = """select *, lead(t) over w as t2, lead(d) over w as d2 from v_scr5 window w as (partition by route_id, trip_id, part order by t)"""
VIEWS["v_scr7"] = """select *, d + (g - t)::double * ((d2 - d) / (t2 - t)) as gd from (select *, unnest(generate_series(((t + 9) // 10) * 10, t2 - 1, 10)) as g from v_scr6 where t2 is not null)"""


@case("c08_clean_scraped_trips", f"""select route_id as route, trip_id as trip_folder, part, g as datetime, {rs('round_even(gd * 100, 0)::double / 100', 1)} as travel_distance_m, {rs('round_even((d2 - d) / (t2 - t) * 100, 0)::double / 100', 1)} as moving_speed_m_s from v_scr7""")
def _(spark, d):
    out = scraped_plan.clean_trips(_scan(spark, d), _segments(spark, d), "S0", 200.0)
    return rounded(out.select("route", "trip_folder", "part", "datetime", "travel_distance_m", "moving_speed_m_s"), 1)
