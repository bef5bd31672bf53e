"""The same inputs and intermediate results as plain SQL for the comparison engine.

Local time is UTC-5 throughout: all fixture times lie in one winter night.
"""

VIEWS: dict[str, str] = {}

VIEWS["v_base"] = """
select *, (epoch_us(ts) - 1704067200000000) // 1440000000 as base from events"""

VIEWS["v_ping"] = """
select event_id as id, user_id, 'V' || user_id as vehicle_id, 'T' || user_id as trip_id,
  'R' || (user_id // 20) as route_id, (user_id % 2)::bigint as direction_id,
  1704067200 + base + 3600 * ((user_id // 20) % 12) + 2700 as vt_s,
  (5e0 + ((user_id * 7) % 11) * 2e-1)
    * (case when user_id % 4 = 0 then least(base, 600) + greatest(base - 960, 0) else base end)
    + 3e2 * ((user_id % 20) // 2)
    + (case when user_id % 4 = 0 and base between 600 and 960 then 0e0 else value end) as dist_m,
  event_type, value
from v_base"""

VIEWS["v_vp"] = """
select *, id // 10 as snapshot_id, vt_s + id % 7 as fetched_s,
  case when id % 50 <> 0 then vt_s end as veh_s,
  case when id % 50 <> 0 then vt_s else vt_s + id % 7 end as dt_s,
  case when user_id % 3 = 0 then '20240101' end as feed_date,
  case when user_id % 3 = 0 then '20240101' else strftime(make_timestamp(
    (case when id % 50 <> 0 then vt_s else vt_s + id % 7 end - 18000) * 1000000), '%Y%m%d') end as start_date,
  lpad((6 + user_id % 20)::varchar, 2, '0') || ':15:00' as start_time,
  43.65e0 + dist_m / 111132e0 as latitude, -79.38e0 + (value - 50e0) / 80400e0 as longitude,
  case when event_type <> 'error' then 5e0 + (id % 17) / 2e0 end as speed_mps,
  case event_type when 'view' then 'IN_TRANSIT_TO' when 'click' then 'STOPPED_AT'
    when 'signup' then 'INCOMING_AT' end as current_status,
  case event_type when 'click' then 'EMPTY' when 'view' then 'MANY_SEATS_AVAILABLE'
    when 'signup' then 'STANDING_ROOM_ONLY' when 'purchase' then 'FULL' end as occupancy_status
from v_ping"""

VIEWS["v_inst"] = """
select * from v_vp qualify row_number() over (partition by trip_id, start_date, dt_s order by id desc) = 1"""

VIEWS["v_spd"] = """
select *, coalesce((dist_m - lag(dist_m) over w) / (dt_s - lag(dt_s) over w), 0e0) as speed
from v_inst window w as (partition by trip_id, start_date order by dt_s)"""

VIEWS["v_pair"] = """
select *, lead(dt_s) over w as dt2, lead(dist_m) over w as d2, lead(speed) over w as v2,
  lead(occupancy_status) over w as occ2, lead(id) over w as id2
from v_spd window w as (partition by trip_id, start_date order by dt_s)"""

VIEWS["v_up"] = """
select *, unnest(generate_series(((dt_s + 9) // 10) * 10, dt2 - 1, 10)) as g from v_pair where dt2 is not null"""

VIEWS["v_updist"] = """
select *, dist_m + (g - dt_s)::double * v2 as gd from v_up"""

VIEWS["v_traj"] = """
select trip_id, start_date, start_date as service_date, route_id, direction_id, vehicle_id, g as t,
  round_even(gd * 100, 0)::double / 100 as dist, round_even(v2 * 100, 0)::double / 100 as speed,
  case when gd >= (dist_m + d2) / 2 then occ2 else occupancy_status end as occ,
  case when gd >= (dist_m + d2) / 2 then id2 else id end as src
from v_updist"""

# Runs cut at stretches of 330 s below 0.5 m/s; ghosts under 500 m dropped.
VIEWS["v_still"] = """
select *, case when dist <= 0 then 0e0 when dist >= 15000 then 30e0 else floor(dist / 500) + (dist - 500 * floor(dist / 500)) / 500e0 end as stop_index, abs(speed) < 5e-1 as still,
  row_number() over (partition by trip_id, start_date, vehicle_id order by t) as rn
from v_traj"""
VIEWS["v_stretch"] = """
select *, rn - row_number() over (partition by trip_id, start_date, vehicle_id, still order by t) as st from v_still"""
VIEWS["v_stale"] = """
select *, still and max(t) over q - min(t) over q >= 330 as stale,
  min(t) over q as st0, count(*) over (partition by trip_id, start_date, vehicle_id) as grp
from v_stretch window q as (partition by trip_id, start_date, vehicle_id, still, st)"""
VIEWS["v_seg"] = """
select *, (count(distinct case when stale then st0 end) over (
  partition by trip_id, start_date, vehicle_id order by t))::bigint as segment from v_stale"""
VIEWS["v_segm"] = """
select *, abs(dist - lag(dist) over q) as moved from v_seg
window q as (partition by trip_id, start_date, vehicle_id, segment, stale order by t)"""
VIEWS["v_kept"] = """
select *, grp = 1 or (not stale and count(*) over q >= 2 and coalesce(sum(moved) over q, 0) >= 500) as kept
from v_segm window q as (partition by trip_id, start_date, vehicle_id, segment, stale)"""
VIEWS["v_bus"] = """
select service_date, route_id, direction_id, trip_id, start_date, vehicle_id, segment, t, dist, speed, occ,
  stop_index, trip_id || '|' || start_date || '|' || segment as bus,
  dense_rank() over (partition by service_date, route_id, direction_id
    order by trip_id, start_date, vehicle_id, segment) - 1 as bus_index
from v_kept where kept"""

_MOD = "((({t}) - 18000) % 86400) // 3600 * 60 + ((({t}) - 18000) % 3600) // 60 + ((({t}) - 18000) % 60) / 60e0"


def local_minute(t: str) -> str:
    """Minute of the local day of whole epoch seconds."""
    return "(" + _MOD.format(t=t) + ")"


VIEWS["v_idle"] = f"""
select service_date, route_id, direction_id, bus_index, {local_minute('(min(t) + max(t)) // 2')} as minute_of_day,
  (arg_min(stop_index, t) + arg_max(stop_index, t)) / 2 as stop_index, 'idle' as type, null::varchar as method
from (select *, count(*) filter (where not speed < 5e-1) over (partition by service_date, route_id, direction_id, bus_index order by t) as run
  from v_bus) where speed < 5e-1
group by service_date, route_id, direction_id, bus_index, run having max(t) - min(t) >= 300"""

VIEWS["v_crowd"] = f"""
select service_date, route_id, direction_id, bus_index, {local_minute('(min(t) + max(t)) // 2')} as minute_of_day,
  (arg_min(stop_index, t) + arg_max(stop_index, t)) / 2 as stop_index, 'crowd' as type, null::varchar as method
from (select *, count(*) filter (where occ is distinct from 'FULL') over (partition by service_date, route_id, direction_id, bus_index order by t) as run
  from v_bus) where occ = 'FULL'
group by service_date, route_id, direction_id, bus_index, run"""

VIEWS["v_leg"] = """
select *, lead(t) over w as t2, lead(stop_index) over w as s2
from v_bus window w as (partition by service_date, route_id, direction_id, bus_index order by t)"""
VIEWS["v_leg2"] = """
select *, stop_index <= s2 as upward, least(stop_index, s2) as lo, greatest(stop_index, s2) as hi,
  case when stop_index <= s2 then t else t2 end * 1000000 as tl, case when stop_index <= s2 then t2 else t end * 1000000 as th,
  unnest(generate_series(ceil(least(stop_index, s2))::bigint, floor(greatest(stop_index, s2))::bigint)) as stop
from v_leg where t2 is not null"""
VIEWS["v_cross"] = """
select service_date, route_id, direction_id, bus_index, trip_id, stop, upward,
  (case when hi <= lo then tl else tl + round_even((stop - lo) / (hi - lo) * (th - tl), 0)::bigint end) as cross_us
from v_leg2
qualify row_number() over (partition by service_date, route_id, direction_id, bus_index, stop order by t) = 1"""
VIEWS["v_btime"] = f"""
select service_date, route_id, direction_id, bus_index, {local_minute('(cross_us // 1000000)')} as minute_of_day,
  stop::double as stop_index, 'bunch' as type, 'time' as method
from (select *, cross_us - lag(cross_us) over (partition by service_date, route_id, direction_id, stop order by cross_us, bus_index) as gap from v_cross)
where gap > 0 and gap < 120000000"""

VIEWS["v_track"] = """
select *, count(*) over (partition by service_date, route_id, direction_id, bus_index) as n from v_bus"""
VIEWS["v_start"] = """
select service_date, route_id, direction_id, min(t) as t0 from v_track where n >= 2 group by all"""
VIEWS["v_tick"] = """
select b.service_date, b.route_id, b.direction_id, b.bus_index, (k.k) as tick, s.t0 + 30 * k.k as t,
  case when k.k * 30 + s.t0 = b.t then b.dist else b.dist + (s.t0 + 30 * k.k - b.t)::double / (b.t2 - b.t) * (b.d2 - b.dist) end as dist,
  case when k.k * 30 + s.t0 = b.t then b.stop_index else b.stop_index + (s.t0 + 30 * k.k - b.t)::double / (b.t2 - b.t) * (b.s2 - b.stop_index) end as stop_index
from (select *, lead(t) over w as t2, lead(dist) over w as d2, lead(stop_index) over w as s2 from v_track where n >= 2
      window w as (partition by service_date, route_id, direction_id, bus_index order by t)) b
join v_start s using (service_date, route_id, direction_id),
lateral (select unnest(generate_series((b.t - s.t0 + 29) // 30, (coalesce(b.t2 - 1, b.t) - s.t0) // 30)) as k) k"""
VIEWS["v_adj"] = """
select *, lead(bus_index) over w as leader, lead(dist) over w - dist as gap
from v_tick window w as (partition by service_date, route_id, direction_id, tick order by dist, bus_index)"""
VIEWS["v_bdist"] = f"""
select service_date, route_id, direction_id, bus_index, {local_minute('((min(t) + max(t)) // 2)')} as minute_of_day,
  (arg_min(stop_index, tick) + arg_max(stop_index, tick)) / 2 as stop_index, 'bunch' as type, 'distance' as method
from (select *, tick - row_number() over (partition by service_date, route_id, direction_id, bus_index, leader order by tick) as isl
  from v_adj where leader is not null and gap > 0 and gap < 150)
group by service_date, route_id, direction_id, bus_index, leader, isl"""
VIEWS["v_event"] = """
select * from v_idle union all select * from v_crowd union all select * from v_btime union all select * from v_bdist"""

VIEWS["v_trips"] = """
select distinct 'T' || user_id as trip_id, 'R' || (case when user_id % 13 = 5 then user_id // 20 + 1 else user_id // 20 end) as route_id,
  case when user_id % 10 = 9 then 'sat' else 'wk' end as service_id, (user_id % 2)::bigint as direction_id,
  case when user_id % 7 = 0 then 'S1' else 'S0' end as shape_id, user_id
from events"""
VIEWS["v_stoptimes"] = """
select trip_id, user_id, s.s as stop_sequence, 'P' || s.s as stop_id, 21600 + 360 * user_id + 60 * s.s as dep_s
from v_trips, (select unnest(generate_series(0, 30)) as s) s"""
