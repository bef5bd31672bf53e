"""Bus grouping, detectors and slice rollups."""

from pyspark.sql import functions as F

from tramline.operators import buses, detect, rollups
from tramline.plans import slices

from . import fixtures as fx
from .registry import PLAIN, case, rounded, rs
from .sql_views import local_minute

_SL = "service_date, route_id, direction_id"
_EV = f"{_SL}, bus_index, {rs('minute_of_day')} as minute_of_day, {rs('stop_index')} as stop_index, type, method"


def _events_out(events, points):
    return rounded(buses.number_buses(events, points).select(
        *buses.SLICE, "bus_index", "minute_of_day", "stop_index", "type", "method"))


@case("j08_distance_to_stop_index", f"""
select trip_id, t as datetime, {rs('stop_index')} as stop_index from v_still""")
def _(spark, d):
    out = buses.distance_to_stop_index(fx.trajectories(spark, d), fx.route_stops(spark, d))
    return rounded(out.select("trip_id", "datetime", "stop_index"))


@case("w10_segment_vehicle_points", "select trip_id, start_date, vehicle_id, segment, t as datetime from v_bus")
def _(spark, d):
    out = buses.segment_vehicle_points(fx.trajectories(spark, d), stale_s=330.0)
    return rounded(out.select("trip_id", "start_date", "vehicle_id", "segment", "datetime"))


@case("w11_group_into_buses", f"select {_SL}, bus_index, t as datetime, {rs('stop_index')} as stop_index from v_bus")
def _(spark, d):
    pts = fx.bus_points(spark, d)
    return rounded(buses.number_buses(pts, pts).select(*buses.SLICE, "bus_index", "datetime", "stop_index"))


@case("w12_idle_events", f"select {_EV} from v_idle")
def _(spark, d):
    pts = fx.bus_points(spark, d)
    return _events_out(detect.idle_events(pts), pts)


@case("w13_crowd_events", f"select {_EV} from v_crowd")
def _(spark, d):
    pts = fx.bus_points(spark, d)
    return _events_out(detect.crowd_events(pts), pts)


@case("w14_stop_crossings", f"select {_SL}, bus_index, stop, cross_us from v_cross")
def _(spark, d):
    pts = fx.bus_points(spark, d)
    return rounded(buses.number_buses(detect.stop_crossings(pts), pts).select(*buses.SLICE, "bus_index", "stop", "cross_us"))


@case("w15_bunch_time_events", f"select {_EV} from v_btime")
def _(spark, d):
    pts = fx.bus_points(spark, d)
    return _events_out(detect.bunch_time_events(detect.stop_crossings(pts)), pts)


@case("w16_interpolate_on_ticks", f"select {_SL}, bus_index, tick, t, {rs('dist')} as dist, {rs('stop_index')} as stop_index from v_tick")
def _(spark, d):
    pts = fx.bus_points(spark, d)
    return rounded(buses.number_buses(detect.interpolate_on_ticks(pts), pts).select(
        *buses.SLICE, "bus_index", "tick", F.expr("t_us div 1000000").alias("t"), F.col("dist_m").alias("dist"), "stop_index"))


@case("w17_bunch_distance_events", f"select {_EV} from v_bdist")
def _(spark, d):
    pts = fx.bus_points(spark, d)
    return _events_out(detect.bunch_distance_events(detect.interpolate_on_ticks(pts)), pts)


@case("w17_bunch_distance_hysteresis", f"""
select {_SL}, bus_index, min(case when gap < 100 then t end) as t0, max(t) as t1
from (select *, tick - row_number() over (partition by {_SL}, bus_index, leader order by tick) as isl
  from v_adj where leader is not null and gap > 0 and gap < 200)
group by {_SL}, bus_index, leader, isl
having min(case when gap < 100 then t end) is not null and max(t) - min(case when gap < 100 then t end) >= 60""")
def _(spark, d):
    pts = fx.bus_points(spark, d)
    runs = detect.bunch_distance_runs(detect.interpolate_on_ticks(pts), 100.0, 200.0, 60.0)
    return rounded(buses.number_buses(runs, pts).select(
        *buses.SLICE, "bus_index", F.expr("t0_us div 1000000").alias("t0"), F.expr("t1_us div 1000000").alias("t1")))


@case("w18_detect_all", f"select {_EV} from v_event")
def _(spark, d):
    pts = fx.bus_points(spark, d)
    return _events_out(detect.detect_all(pts, method="both"), pts)


def _both(spark, d):
    pts = fx.bus_points(spark, d)
    return pts, detect.detect_all(pts, method="both")


_AXIS = "(select distinct service_date, route_id, direction_id from v_bus)"
_HOUR = "(floor(minute_of_day / 60)::bigint % 24)"


@case("a14_hourly_anomaly_counts", f"""
select {_SL}, h.hour, count(*) filter (where type = 'bunch') as bunch, count(*) filter (where type = 'idle') as idle,
 count(*) filter (where type = 'crowd') as crowd
from {_AXIS} s cross join (select unnest(generate_series(0, 23)) as hour) h
left join (select *, {_HOUR} as hour from v_event) e using ({_SL}, hour) group by {_SL}, h.hour""")
def _(spark, d):
    pts, ev = _both(spark, d)
    return rounded(rollups.hourly_anomaly_counts(ev, pts))


@case("a15_stop_anomaly_counts", f"""
select {_SL}, h.stop, count(*) filter (where type = 'bunch') as bunch, count(*) filter (where type = 'idle') as idle,
 count(*) filter (where type = 'crowd') as crowd, count(type) as total
from {_AXIS} s cross join (select unnest(generate_series(0, 30)) as stop) h
left join (select * replace (round_even(stop_index, 0)::bigint as stop_index) from v_event) e
  on e.service_date = s.service_date and e.route_id = s.route_id and e.direction_id = s.direction_id and e.stop_index = h.stop
group by s.service_date, s.route_id, s.direction_id, h.stop""".replace(f"select {_SL}, h.stop", "select s.service_date, s.route_id, s.direction_id, h.stop", 1))
def _(spark, d):
    pts, ev = _both(spark, d)
    return rounded(rollups.stop_anomaly_counts(ev, fx.route_stops(spark, d), pts))


_PH = "(((t - 18000) % 86400) // 3600)"


@case("a16_hourly_moving_speed", f"""
select {_SL}, h.hour, {rs('avg(speed * 3.6e0)')} as speed_kph
from {_AXIS} s cross join (select unnest(generate_series(0, 23)) as hour) h
left join (select *, {_PH} as hour from v_bus where speed >= 5e-1) p using ({_SL}, hour) group by {_SL}, h.hour""")
def _(spark, d):
    return rounded(rollups.hourly_moving_speed(fx.bus_points(spark, d)))


_NEAR = f"""(select b.*, exists (select 1 from v_event e where e.type = 'bunch'
  and e.service_date = b.service_date and e.route_id = b.route_id and e.direction_id = b.direction_id
  and e.bus_index = b.bus_index and abs(e.minute_of_day - {local_minute('b.t')}) <= 5e-1) as near_bunch from v_bus b)"""


@case("j14_near_event_flag", f"select {_SL}, bus_index, t as datetime, near_bunch from {_NEAR}")
def _(spark, d):
    pts, ev = _both(spark, d)
    out = rollups.near_event_flag(pts, ev)
    return rounded(buses.number_buses(out, pts).select(*buses.SLICE, "bus_index", "datetime", "near_bunch"))


def _pct(cond):
    return f"100e0 * count(*) filter (where {cond}) / count(*)"


_I, _C = "speed < 5e-1", "not speed < 5e-1 and occ = 'FULL'"
_B = "not speed < 5e-1 and occ is distinct from 'FULL' and near_bunch"


@case("a17_hourly_time_allocation", f"""
select s.service_date, s.route_id, s.direction_id, h.hour,
 coalesce(normal_pct, 0) as normal_pct, coalesce(idle_pct, 0) as idle_pct, coalesce(bunch_pct, 0) as bunch_pct, coalesce(crowd_pct, 0) as crowd_pct
from {_AXIS} s cross join (select unnest(generate_series(0, 23)) as hour) h
left join (select {_SL}, {_PH} as hour,
 round_even(greatest(0e0, 100 - {_pct(_I)} - {_pct(_B)} - {_pct(_C)}) * 10, 0)::double / 10 as normal_pct,
 round_even({_pct(_I)} * 10, 0)::double / 10 as idle_pct, round_even({_pct(_B)} * 10, 0)::double / 10 as bunch_pct,
 round_even({_pct(_C)} * 10, 0)::double / 10 as crowd_pct from {_NEAR} group by {_SL}, {_PH}) x using ({_SL}, hour)""")
def _(spark, d):
    pts, ev = _both(spark, d)
    return rounded(rollups.hourly_time_allocation(pts, ev))


@case("a18_slice_totals", f"""
select {_SL}, start_min, end_min, num_vehicles, bunch, idle, crowd, bunch_time, bunch_dist from
(select {_SL}, min(round_even(((t0 - 18000) % 86400) / 60e0 * 100, 0)::double / 100) as start_min,
  max(round_even(((t1 - 18000) % 86400) / 60e0 * 100, 0)::double / 100) as end_min, count(distinct vehicle_id) as num_vehicles
 from (select {_SL}, bus_index, vehicle_id, min(t) as t0, max(t) as t1 from v_bus group by all) group by {_SL})
left join (select {_SL}, count(*) filter (where type = 'bunch') as bunch, count(*) filter (where type = 'idle') as idle,
  count(*) filter (where type = 'crowd') as crowd, count(*) filter (where method = 'time') as bunch_time,
  count(*) filter (where method = 'distance') as bunch_dist from v_event group by {_SL}) using ({_SL})""")
def _(spark, d):
    pts, ev = _both(spark, d)
    return rounded(rollups.slice_totals(ev, pts))


@case("c02_slice_view", f"""
select {_SL}, bunch, idle, crowd, bunch_time, bunch_dist from (select {_SL}, count(*) filter (where type = 'bunch') as bunch, count(*) filter (where type = 'idle') as idle,
 count(*) filter (where type = 'crowd') as crowd, count(*) filter (where method = 'time') as bunch_time, count(*) filter (where method = 'distance') as bunch_dist
 from v_event group by {_SL})""")
def _(spark, d):
    view = slices.slice_view(fx.trajectories(spark, d), fx.route_stops(spark, d), stale_s=330.0, method="both")
    return rounded(view.totals.select(*buses.SLICE, "bunch", "idle", "crowd", "bunch_time", "bunch_dist"))


# table, its slot column, its measures and the case that states it alone
_ANALYTICS = {
    "hourly_counts": ("hour", ("bunch", "idle", "crowd"), "a14_hourly_anomaly_counts"),
    "stop_counts": ("stop", ("bunch", "idle", "crowd", "total"), "a15_stop_anomaly_counts"),
    "hourly_speed": ("hour", ("speed_kph",), "a16_hourly_moving_speed"),
    "hourly_allocation": ("hour", ("normal_pct", "idle_pct", "bunch_pct", "crowd_pct"), "a17_hourly_time_allocation"),
}


@case("c03_slice_analytics", " union all ".join(
    f"select '{name}' as part, {_SL}, {slot} as slot, '{m}' as measure, {m}::double as value from ({PLAIN[alone]})"
    for name, (slot, measures, alone) in _ANALYTICS.items() for m in measures))
def _(spark, d):
    """All four tables of every slice, a measure to a row."""
    view = slices.slice_view(fx.trajectories(spark, d), fx.route_stops(spark, d), stale_s=330.0, method="both")
    tables, out = slices.slice_analytics(view, fx.route_stops(spark, d)), None
    for name, (_, measures, _) in _ANALYTICS.items():
        table = rounded(tables[name])
        slot = next(c for c in table.columns if c not in (*buses.SLICE, *measures))
        part = table.select(F.lit(name).alias("part"), *buses.SLICE, F.col(slot).cast("bigint").alias("slot"), F.inline(F.array(*[
            F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])))
        out = part if out is None else out.unionByName(part)
    return out


@case("flagship_bunching_by_route_hour", f"""
select route_id, {_HOUR} as hour, count(*) as bunching, count(distinct {"bus_index * 100 + direction_id * 10 + (service_date = '20240101')::int"}) as buses, {rs('avg(stop_index)')} as mean_stop
from v_bdist group by 1, 2""")
def _(spark, d):
    return flagship(spark, d)


def flagship(spark, d):
    """Distance-bunching events per route and local hour, from raw pings to the rollup."""
    ev = detect.bunch_distance_events(detect.interpolate_on_ticks(fx.bus_points(spark, d)))
    hour = (F.floor(F.col("minute_of_day") / 60) % 24).cast("int")
    return rounded(ev.groupBy("route_id", hour.alias("hour")).agg(
        F.count("*").alias("bunching"), F.countDistinct("service_date", "direction_id", "bus_id").alias("buses"), F.avg("stop_index").alias("mean_stop")))
