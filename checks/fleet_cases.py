"""Filters, latest state, rollups and top-k over pings, fetch logs and stored trajectories."""

from pyspark.sql import functions as F

from tramline.functions import times, values
from tramline.operators import fleet
from tramline.plans import catalog
from tramline.session import materialise, shared_dir
from tramline.sources import store

from . import fixtures as fx
from .registry import case, r, rounded, rs
from .sql_views import VIEWS

VIEWS["v_log"] = """
select event_id as id, 'feed' || (user_id % 3) as feed_name, epoch_us(ts) as us, ts, epoch_us(ts) // 1000000 as t,
  case when event_type = 'error' then 500 else 200 end as http_status, event_type <> 'error' as success,
  floor(value)::bigint as duration_ms, case when event_type <> 'error' then 1000 + user_id % 600 end as entity_count,
  case when event_type <> 'error' then epoch_us(ts) // 1000000 - event_id % 40 end as header_t,
  case when event_type = 'error' then 'HttpError' end as error_type,
  case when event_type = 'error' then props end as error_message,
  event_type || (event_id // 3) as content
from events"""

T0 = 1704067200 + 2700  # first ping of route R0


def at(epoch: int):
    return F.timestamp_seconds(F.lit(epoch))


_LATEST = "select * from v_vp {where} qualify row_number() over (partition by {key} order by fetched_s desc, id desc) = 1"


@case("f01_vehicle_history", f"""select id, fetched_s as fetched_at from v_vp where vehicle_id = 'V7'
 and fetched_s >= {T0 + 300} and fetched_s < {T0 + 1200} order by fetched_s desc, id desc""")
def _(spark, d):
    return rounded(fleet.vehicle_history(fx.vehicle_positions(spark, d), "V7", at(T0 + 300), at(T0 + 1200)).select("id", "fetched_at"))


@case("f02_replay_window", f"""select id, fetched_s as fetched_at from v_vp where fetched_s >= {T0} and fetched_s < {T0 + 7200}
 order by fetched_s, id""")
def _(spark, d):
    return rounded(fleet.replay_window(fx.vehicle_positions(spark, d), at(T0), at(T0 + 7200)).select("id", "fetched_at"))


@case("f03_snapshots_window", """select id, t as fetched_at from v_log where feed_name = 'feed1' and us between
 1704067200000000 and 1704067200000000 + 864000000000 order by us, id""")
def _(spark, d):
    out = fleet.snapshots_window(fx.fetch_logs(spark, d), "feed1", at(1704067200), at(1704067200 + 864000))
    return rounded(out.select("id", "fetched_at"))


@case("f04_trip_instance_rows", """select id, dt_s as datetime from v_vp where trip_id = 'T7' and start_date = '20231231' order by dt_s, id""")
def _(spark, d):
    vp = fx.vehicle_positions(spark, d)
    out = fleet.trip_instance_rows(vp, "T7", "20231231", times.fetch_window("2023-12-31"))
    return rounded(out.select("id", F.coalesce("vehicle_timestamp", "fetched_at").alias("datetime")))


@case("f05_fetched_at_window", """select id from v_vp where fetched_s >= 1703980800 + 18000 - 7200
 and fetched_s < 1703980800 + 18000 + 86400 + 7200""")
def _(spark, d):
    return fleet.fetched_in_window(fx.vehicle_positions(spark, d), "2023-12-31", 2).select("id")


@case("f06_trip_trajectory", "select t as datetime, dist as travel_distance_m from v_traj where trip_id = 'T9' and start_date = '20240101' order by t")
def _(spark, d):
    return rounded(fleet.trip_trajectory(fx.trajectories(spark, d), "T9", "20240101").select("datetime", "travel_distance_m"))


@case("f07_trajectory_slice", "select trip_id, t as datetime from v_traj where service_date = '20231231' and route_id = 'R0' and direction_id = 1")
def _(spark, d):
    out = fleet.trajectory_slice(fx.trajectories(spark, d), F.to_date(F.lit("2023-12-31")), "R0", 1)
    return rounded(out.select("trip_id", "datetime"))


@case("l05_slice_order", """select trip_id, t as datetime from v_traj where service_date = '20240101' and route_id = 'R0' and direction_id = 0
 order by trip_id, start_date, vehicle_id, t""")
def _(spark, d):
    out = fleet.trajectory_slice(fx.trajectories(spark, d), F.to_date(F.lit("2024-01-01")), "R0", 0)
    return rounded(out.select("trip_id", "datetime"))


@case("f08_time_of_day_filter", "select event_id as id from events where strftime(ts, '%H:%M:%S') between '06:00:00' and '22:00:00'")
def _(spark, d):
    return fleet.time_of_day_filter(fx.table(spark, d, "events"), "ts", "06:00:00", "22:00:00").select(F.col("event_id").alias("id"))


_BOX = (-79.3802, 43.66, -79.3798, 43.70)


@case("f09_bbox_filter", "select id from v_vp where longitude between -79.3802e0 and -79.3798e0 and latitude between 43.66e0 and 43.70e0")
def _(spark, d):
    return fleet.bbox_filter(fx.vehicle_positions(spark, d), _BOX).select("id")


_HAV = """2 * 6371000e0 * asin(sqrt(pow(sin(radians(43.66e0 - latitude) / 2), 2)
 + cos(radians(latitude)) * cos(radians(43.66e0)) * pow(sin(radians(-79.38e0 - longitude) / 2), 2)))"""


@case("f10_within_radius_latest", f"""
select vehicle_id, route_id, {rs('m')} as meters, fetched_s as fetched_at from (select *, {_HAV} as m from v_vp)
where m <= 500 and fetched_s > {T0} qualify row_number() over (partition by vehicle_id order by fetched_s desc, id desc) = 1""")
def _(spark, d):
    out = fleet.within_radius_latest(fx.vehicle_positions(spark, d), -79.38, 43.66, 500.0, at(T0))
    return rounded(out.drop("id"))


@case("p09_haversine_m", f"select id, {rs(_HAV)} as meters from v_vp")
def _(spark, d):
    from tramline.functions import geo

    vp = fx.vehicle_positions(spark, d)
    return rounded(vp.select("id", geo.haversine_m(F.col("longitude"), F.col("latitude"), F.lit(-79.38), F.lit(43.66)).alias("meters")))


@case("f12_drop_null_positions", "select id from v_vp where event_type <> 'error'")
def _(spark, d):
    from tramline.operators import trajectory

    vp = fx.vehicle_positions(spark, d).withColumn("latitude", F.when(F.col("event_type") != "error", F.col("latitude")))
    return trajectory.drop_null_positions(vp).select("id")


@case("f13_spatial_outliers", f"""
select count(*) as rows, count(*) filter (where event_type = 'error') as missing,
 count(*) filter (where event_type <> 'error' and not (longitude between -79.3802e0 and -79.3798e0 and latitude between 43.66e0 and 43.70e0)) as outliers,
 {rs("100e0 * count(*) filter (where event_type <> 'error' and not (longitude between -79.3802e0 and -79.3798e0 and latitude between 43.66e0 and 43.70e0)) / count(*) filter (where event_type <> 'error')")} as outlier_pct
from v_vp""")
def _(spark, d):
    vp = fx.vehicle_positions(spark, d).withColumn("latitude", F.when(F.col("event_type") != "error", F.col("latitude")))
    return rounded(fleet.spatial_outliers(vp, _BOX))


@case("w06_latest_per_key", f"select vehicle_id, id, fetched_s as fetched_at from ({_LATEST.format(key='vehicle_id', where='where fetched_s >= %d' % T0)})")
def _(spark, d):
    vp = fx.vehicle_positions(spark, d).select("vehicle_id", "id", "fetched_at")
    return rounded(fleet.latest_per_key(vp, since=at(T0)))


@case("w06_latest_on_route", f"select vehicle_id, id from ({_LATEST.format(key='vehicle_id', where=chr(39).join(['where route_id = ', 'R0', '']))}) order by fetched_s desc, id desc")
def _(spark, d):
    vp = fx.vehicle_positions(spark, d).select("vehicle_id", "id", "fetched_at", "route_id")
    return fleet.newest_first(fleet.latest_per_key(vp, route_id="R0")).select("vehicle_id", "id")


@case("w07_snapshot_bucket_latest", f"select vehicle_id, id from ({_LATEST.format(key='vehicle_id', where=f'where fetched_s > {T0 + 840} and fetched_s <= {T0 + 900}')})")
def _(spark, d):
    vp = fx.vehicle_positions(spark, d).select("vehicle_id", "id", "fetched_at")
    return fleet.snapshot_bucket_latest(vp, at(T0 + 900), F.expr("interval 60 seconds")).select("vehicle_id", "id")


@case("l01_page_cap", "select id from v_vp order by fetched_s desc, id desc limit 5000")
def _(spark, d):
    vp = fx.vehicle_positions(spark, d)
    return fleet.page_cap(vp.orderBy(F.desc("fetched_at"), F.desc("id")), 9999, cap=5000).select("id")


@case("l02_recent_fetches", "select id from v_log where feed_name = 'feed2' order by us desc, id desc limit 50")
def _(spark, d):
    return fleet.recent_fetches(fx.fetch_logs(spark, d), "feed2", 50).select("id")


@case("l03_top_routes", f"""select route_id, count(*) as vehicles from ({_LATEST.format(key='vehicle_id', where='')})
 group by 1 order by 2 desc, 1 limit 15""")
def _(spark, d):
    return fleet.top_routes(fleet.latest_per_key(fx.vehicle_positions(spark, d).select("vehicle_id", "route_id", "fetched_at", "id")), 15)


_NOW = 1704067200 + 29 * 86400


@case("a01_feed_status", f"""
select feed_name, arg_max(t, us * 100000000::hugeint + id) as last_fetched_at, max(case when success then t end) as last_success_at,
 arg_max(http_status, us * 100000000::hugeint + id)::bigint as last_http_status,
 count(*) filter (where t >= ({_NOW} - 3600)) as fetches_last_hour,
 count(*) filter (where t >= ({_NOW} - 3600) and success) as successes_last_hour,
 count(*) filter (where t >= ({_NOW} - 3600) and not success) as failures_last_hour,
 case when count(*) filter (where t >= ({_NOW} - 3600)) > 0 then
 {rs(f"count(*) filter (where t >= ({_NOW} - 3600) and success) / count(*) filter (where t >= ({_NOW} - 3600))")} end as success_rate_last_hour,
 arg_max(coalesce((({_NOW} - header_t)::double)::varchar, ''), us * 100000000::hugeint + id) as lag_text
from v_log group by feed_name""")
def _(spark, d):
    out = fleet.feed_status(fx.fetch_logs(spark, d), at(_NOW))
    return rounded(out.select(
        "feed_name", "last_fetched_at", "last_success_at", "last_http_status", "fetches_last_hour",
        "successes_last_hour", "failures_last_hour", "success_rate_last_hour",
        F.coalesce(F.col("lag_seconds").cast("string"), F.lit("")).alias("lag_text")))


def _map_text(c):
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


_RL = _LATEST.format(key="route_id, vehicle_id", where=f"where fetched_s >= {T0 + 900}")


@case("a02_route_metrics", f"""
select m.*, s.status_breakdown, o.occupancy_breakdown from
(select route_id, count(*) as active_vehicle_count, max(fetched_s) as latest_fetched_at, {rs('avg(speed_mps)')} as avg_speed_mps,
 {rs('max(speed_mps)')} as max_speed_mps, {rs('min(latitude)', 6)} as min_lat, {rs('max(latitude)', 6)} as max_lat,
 {rs('min(longitude)', 6)} as min_lon, {rs('max(longitude)', 6)} as max_lon from ({_RL}) group by route_id) m
join (select route_id, string_agg(k || '=' || n, ',' order by k) as status_breakdown from
 (select route_id, coalesce(current_status, 'UNKNOWN') as k, count(*) as n from ({_RL}) group by all) group by 1) s using (route_id)
join (select route_id, string_agg(k || '=' || n, ',' order by k) as occupancy_breakdown from
 (select route_id, coalesce(occupancy_status, 'UNKNOWN') as k, count(*) as n from ({_RL}) group by all) group by 1) o using (route_id)""")
def _(spark, d):
    out = fleet.route_metrics(fx.vehicle_positions(spark, d), at(T0 + 900))
    box = {c: r(c, 6) for c in ("min_lat", "max_lat", "min_lon", "max_lon")}
    out = out.withColumns({**box, "status_breakdown": _map_text("status_breakdown"), "occupancy_breakdown": _map_text("occupancy_breakdown")})
    return rounded(out, skip=tuple(box))


@case("a03_active_routes", f"select route_id, max(fetched_s) as last_seen from v_vp where fetched_s >= {T0 + 900} group by 1 order by 2 desc, 1")
def _(spark, d):
    return rounded(fleet.active_routes(fx.vehicle_positions(spark, d), at(T0 + 900)))


@case("a04_fleet_by_route", f"""select route_id, count(*) as active_vehicles, {rs('avg(speed_mps) * 3.6e0')} as avg_speed_kph, max(fetched_s) as latest_seen
 from ({_LATEST.format(key='vehicle_id', where=f'where fetched_s > {T0}')}) group by 1 order by 2 desc, 1""")
def _(spark, d):
    return rounded(fleet.fleet_by_route(fx.vehicle_positions(spark, d), at(T0)))


@case("a05_occupancy_counts", f"select coalesce(occupancy_status, 'UNKNOWN') as occupancy_status, count(*) as n from v_vp where fetched_s > {T0 + 600} group by 1")
def _(spark, d):
    return fleet.occupancy_counts(fx.vehicle_positions(spark, d), at(T0 + 600))


@case("a06_per_minute_counts", "select (us // 60000000) * 60 as minute, success, count(*) as rows from v_log group by 1, 2")
def _(spark, d):
    return rounded(fleet.per_minute_counts(fx.fetch_logs(spark, d), "fetched_at", ["success"]))


@case("a07_replay_summary", f"""select count(*) as rows, count(distinct vehicle_id) as vehicles, count(distinct route_id) as routes,
 {rs('(max(fetched_s) - min(fetched_s)) / 60e0')} as span_min from v_vp where fetched_s >= {T0} and fetched_s < {T0 + 14400}""")
def _(spark, d):
    vp = fx.vehicle_positions(spark, d).filter(fleet.between_half_open(F.col("fetched_at"), at(T0), at(T0 + 14400)))
    return rounded(fleet.replay_summary(vp))


_END = 1704067200 + 2700 + 86400


@case("a08_fleet_snapshot_summary", f"""select count(*) as vehicles, count(distinct route_id) as routes,
 floor(avg({_END} - fetched_s))::bigint as avg_age_s, {rs('avg(speed_mps) * 3.6e0')} as avg_speed_kph from ({_LATEST.format(key='vehicle_id', where='')})""")
def _(spark, d):
    vp = fx.vehicle_positions(spark, d).select("vehicle_id", "route_id", "latitude", "longitude", "speed_mps", "fetched_at", "id")
    return rounded(fleet.fleet_snapshot_summary(fleet.latest_per_key(vp), at(_END)))


@case("a09_trip_instance_summary", f"""
select trip_id, start_date, service_date, max(route_id) as route_id, max(direction_id) as direction_id, max(vehicle_id) as vehicle_id,
 min(t) as first_datetime, max(t) as last_datetime, count(*) as point_count, {rs('max(dist)')} as travel_distance_m
from v_traj where service_date = '20240101' group by 1, 2, 3 order by max(t) desc, trip_id, start_date""")
def _(spark, d):
    return rounded(fleet.trip_instance_summary(fx.trajectories(spark, d), F.to_date(F.lit("2024-01-01"))))


@case("a10_trip_detail_summary", f"""
select trip_id, start_date, count(*) as points, {rs('(max(t) - min(t)) / 60e0')} as duration_min,
 {rs('arg_max(round_even(dist, 0)::double / 1000e0, t)')} as distance_km,
 {rs('avg(case when kph <> 0 then kph end)')} as mean_moving_kph, {rs('max(kph)')} as max_kph
from (select *, round_even(speed * 3.6e0 * 100, 0)::double / 100 as kph from v_traj) group by 1, 2""")
def _(spark, d):
    return rounded(fleet.trip_detail_summary(fx.trajectories(spark, d)))


@case("a11_route_catalog", """
select route_id, direction_id, string_agg(service_date, ',' order by service_date desc) as service_dates, sum(n)::bigint as trip_instance_count
from (select route_id, direction_id, service_date, count(*) as n from (select distinct route_id, direction_id, service_date, trip_id, start_date from v_traj) group by 1, 2, 3) group by 1, 2""")
def _(spark, d):
    out = fleet.route_catalog(fx.trajectories(spark, d))
    dates = F.array_join(F.transform("service_dates", lambda x: F.date_format(x, "yyyyMMdd")), ",")
    return rounded(out.withColumn("service_dates", dates))


@case("a11_route_catalog_stored", """
select route_id, direction_id, string_agg(service_date, ',' order by service_date desc) as service_dates, sum(n)::bigint as trip_instance_count
from (select route_id, direction_id, service_date, count(*) as n from (select distinct route_id, direction_id, service_date, trip_id, start_date from v_traj) group by 1, 2, 3) group by 1, 2""")
def _(spark, d):
    """The catalog kept beside the stored table: counted, then recounted for the dates of one route's rewritten instances."""
    path, rollup = shared_dir(spark, "trajectories"), shared_dir(spark, "catalog")
    t = materialise(fx.trajectories(spark, d), "trajectories")
    store.write_trajectories_replace(t, path)
    catalog.refresh_route_catalog(spark, path, rollup)
    store.write_trajectories_replace(t.filter("route_id = 'R1'"), path)
    catalog.refresh_route_catalog(spark, path, rollup)
    out = catalog.route_catalog(spark, rollup)
    dates = F.array_join(F.transform("service_dates", lambda x: F.date_format(x, "yyyyMMdd")), ",")
    return rounded(out.withColumn("service_dates", dates))


@case("a12_service_dates", "select distinct service_date from v_traj order by 1 desc")
def _(spark, d):
    return rounded(fleet.service_dates(fx.trajectories(spark, d)))


@case("a13_routes_on_date", "select distinct route_id from v_traj where service_date = '20240101' order by 1")
def _(spark, d):
    return fleet.routes_on_date(fx.trajectories(spark, d), F.to_date(F.lit("2024-01-01")))


@case("a38_richest_slice", """
select route_id, service_date, direction_id, runs from (select route_id, service_date, direction_id, count(*) as runs
 from (select distinct route_id, service_date, direction_id, trip_id, start_date, vehicle_id from v_traj) group by 1, 2, 3)
qualify row_number() over (partition by route_id order by runs desc, service_date desc, direction_id) = 1""")
def _(spark, d):
    return rounded(fleet.richest_slice(fx.trajectories(spark, d)))


@case("w09_consecutive_dup_rate", f"""
select feed_name, count(*) as snaps, count(*) filter (where content = prev) as consec_dups, {rs('count(*) filter (where content = prev) / count(*)')} as consec_dup_rate
from (select *, lag(content) over (partition by feed_name order by us, id) as prev from v_log) group by 1""")
def _(spark, d):
    return rounded(fleet.consecutive_dup_rate(fx.fetch_logs(spark, d)))


@case("p07_occupancy_pct", """select id, case occupancy_status when 'EMPTY' then 0 when 'MANY_SEATS_AVAILABLE' then 25
 when 'STANDING_ROOM_ONLY' then 75 when 'FULL' then 100 else -1 end as pct from v_vp""")
def _(spark, d):
    return rounded(fx.vehicle_positions(spark, d).select("id", values.occupancy_pct(F.lower("occupancy_status")).alias("pct")))


@case("p10_mercator_scale", f"""select id, {rs('1 / cos(radians(latitude))', 6)} as scale,
 {rs('case when gap >= 20000 then gap else gap / (1 / cos(radians(latitude))) end')} as gap_m
 from (select *, case when id % 9 = 0 then 20000e0 else dist_m end as gap from v_vp)""")
def _(spark, d):
    vp = fx.vehicle_positions(spark, d)
    s = values.mercator_scale(F.col("latitude"))
    gap = F.expr("case when id % 9 = 0 then 20000e0 else dist_m end")
    return vp.select("id", r(s, 6).alias("scale"), r(values.descale_gap(gap, s)).alias("gap_m"))


@case("p11_speed_kph", "select id, round_even(coalesce(speed_mps, 0) * 3.6e0 * 10, 0)::double / 10 as speed_kph from v_vp")
def _(spark, d):
    return fx.vehicle_positions(spark, d).select("id", values.speed_kph(F.col("speed_mps")).alias("speed_kph"))


@case("p12_age_seconds", f"select id, {_END} - fetched_s as age_seconds from v_vp")
def _(spark, d):
    return rounded(fx.vehicle_positions(spark, d).select("id", times.age_seconds(F.col("fetched_at"), at(_END)).alias("age_seconds")))


@case("p04_epoch_to_utc", "select id, case when id % 5 <> 0 then vt_s end as ts from v_ping")
def _(spark, d):
    return rounded(fx.pings(spark, d).select("id", times.epoch_to_utc(F.expr("case when id % 5 = 0 then 0 else vt_s end")).alias("ts")))
