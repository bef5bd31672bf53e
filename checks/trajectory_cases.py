"""Trajectory core on the 1-D distance."""

from pyspark.sql import functions as F

from tramline.functions import times
from tramline.operators import trajectory as tr

from . import fixtures as fx
from .registry import case, r, rounded, rs


@case("p01_effective_start_date", "select id, start_date from v_vp")
def _(spark, d):
    vp = fx.vehicle_positions(spark, d)
    return vp.select("id", times.effective_start_date(
        F.col("start_date"), F.col("vehicle_timestamp"), F.col("fetched_at")).alias("start_date"))


@case("w01_dedup_instance_timestamps", "select trip_id, start_date, dt_s as datetime, id from v_inst")
def _(spark, d):
    return rounded(tr.dedup_instance_times(fx.instances(spark, d)).select("trip_id", "start_date", "datetime", "id"))


def _speeds(spark, d):
    return tr.moving_speed(tr.dedup_instance_times(fx.instances(spark, d)))


@case("w03_moving_speed", f"select trip_id, start_date, dt_s as datetime, {rs('speed')} as speed from v_spd")
def _(spark, d):
    return rounded(_speeds(spark, d).select("trip_id", "start_date", "datetime", F.col("moving_speed_m_s").alias("speed")))


@case("w08_upsample_grid", f"""
select trip_id, start_date, g as datetime, {rs('gd')} as dist, {rs('v2')} as speed,
  case when gd >= (dist_m + d2) / 2 then id2 else id end as src from v_updist""")
def _(spark, d):
    pts = _speeds(spark, d).select("trip_id", "start_date", "datetime", "travel_distance_m", "moving_speed_m_s", "id")
    return rounded(tr.upsample_grid(pts).select(
        "trip_id", "start_date", "datetime", F.col("travel_distance_m").alias("dist"),
        F.col("moving_speed_m_s").alias("speed"), F.col("id").alias("src")))


@case("p18_canonical_trajectory_columns", f"""
select trip_id, start_date, service_date, route_id, direction_id, vehicle_id, t as datetime,
 {rs('dist')} as travel_distance_m, {rs('speed')} as moving_speed_m_s, false as observed,
 occ as occupancy_status, src as source_vehicle_position_id from v_traj""")
def _(spark, d):
    return rounded(fx.trajectories(spark, d))


_TELEPORT = """
, ordered as (select *, row_number() over (partition by trip_id, start_date order by dt_s) as rn from v_inst),
fold as (
  select trip_id, start_date, rn, dt_s, id, dist_m, true as keep, dt_s as at, dist_m as ad from ordered where rn = 1
  union all
  select o.trip_id, o.start_date, o.rn, o.dt_s, o.id, o.dist_m,
    abs(o.dist_m - f.ad) <= 35e0 * (o.dt_s - f.at),
    case when abs(o.dist_m - f.ad) <= 35e0 * (o.dt_s - f.at) then o.dt_s else f.at end,
    case when abs(o.dist_m - f.ad) <= 35e0 * (o.dt_s - f.at) then o.dist_m else f.ad end
  from fold f join ordered o on o.trip_id = f.trip_id and o.start_date = f.start_date and o.rn = f.rn + 1)
"""


@case("w02_teleport_filter")
def _(spark, d):
    return rounded(tr.teleport_filter(tr.dedup_instance_times(fx.instances(spark, d))).select("trip_id", "start_date", "datetime", "id"))


def _recursive():
    from .registry import ORACLES, with_views

    head = with_views("select 1 from v_inst")
    head = head[: head.rindex("select 1 from v_inst")]
    ORACLES["w02_teleport_filter"] = (
        head.replace("with ", "with recursive ", 1).rstrip() + _TELEPORT
        + "select trip_id, start_date, dt_s as datetime, id from fold where keep"
    )


_recursive()


@case("j01_attach_static_trip", """
select p.id, t.shape_id, t.route_id as static_route_id, t.direction_id as static_direction_id
from v_vp p left join v_trips t using (trip_id)""")
def _(spark, d):
    out = tr.attach_static_trip(fx.instances(spark, d), fx.trips(spark, d))
    return rounded(out.select("id", "shape_id", "static_route_id", "static_direction_id"))


@case("j02_route_mismatch_guard", """
select id from v_vp where (trip_id, start_date) not in (
 select (k.trip_id, k.start_date) from (select trip_id, start_date, arg_min(route_id, dt_s * 1000000 + id) as rt from v_vp group by all) k
 join v_trips t using (trip_id) where t.route_id <> k.rt)""")
def _(spark, d):
    return tr.route_mismatch_guard(fx.instances(spark, d), fx.trips(spark, d)).select("id")


@case("j03_resolve_trip_kind", """
select trip_id, start_date, case when t.route_id is null then 'none' when t.route_id = rt then 'match' else 'mismatch' end as kind
from (select trip_id, start_date, any_value(route_id) as rt from v_vp group by all) left join v_trips t using (trip_id)""")
def _(spark, d):
    return tr.resolve_trip_kind(fx.instances(spark, d), fx.trips(spark, d)).select("trip_id", "start_date", "kind")


@case("p03_trip_start_utc", """
select id, case when feed_date is not null then
  1704067200 + 18000 + (6 + user_id % 20) * 3600 + 900 end as trip_start from v_vp""")
def _(spark, d):
    vp = fx.vehicle_positions(spark, d)
    return rounded(vp.select("id", times.trip_start_utc(F.col("start_date"), F.col("start_time")).alias("trip_start")))


@case("p06_time_offset_seconds", """
select id, case when feed_date is not null then
  dt_s - (1704067200 + 18000 + (6 + user_id % 20) * 3600 + 900) end as time_offset_seconds from v_inst""")
def _(spark, d):
    out = tr.with_start_offset(tr.dedup_instance_times(fx.instances(spark, d)))
    return rounded(out.select("id", "time_offset_seconds"))


@case("p05_local_minute_of_day", "select id, floor(((vt_s - 18000) % 86400) / 60e0 * 1e3 + 5e-1) / 1e3 as minute from v_vp")
def _(spark, d):
    vp = fx.pings(spark, d)
    return vp.select("id", r(times.local_minute(F.timestamp_seconds("vt_s"))).alias("minute"))


@case("p17_tod_sin_cos", f"""
select id, {rs('sin(2 * pi() * (((vt_s - 18000) % 86400) / 60e0) / 1440)')} as tod_sin,
 {rs('cos(2 * pi() * (((vt_s - 18000) % 86400) / 60e0) / 1440)')} as tod_cos from v_vp""")
def _(spark, d):
    m = times.local_minute(F.timestamp_seconds("vt_s"))
    return rounded(fx.pings(spark, d).select("id", times.tod_sin(m).alias("tod_sin"), times.tod_cos(m).alias("tod_cos")))
