"""Projection, polylines and stops, against a brute-force all-segments SQL."""

from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators import audit, shapes
from tramline.operators import trajectory as tr
from tramline.plans import trajectories as plan
from tramline.session import materialise, shared_dir
from tramline.sources import store

from . import fixtures as fx
from .registry import ORACLES, case, r, rounded, rs, with_views
from .sql_views import VIEWS


def utm_sql(lon: str, lat: str) -> tuple[str, str]:
    """Series of the forward projection as SQL over ``t``, ``xi`` and ``eta`` computed inline."""
    import math

    n = geo.THIRD_FLATTENING
    c = repr(2 * math.sqrt(n) / (1 + n))
    s = f"sin(radians({lat}))"
    lam = f"radians(({lon}) - (-81e0))"
    t = f"sinh(atanh({s}) - {c}::double * atanh({c}::double * {s}))"
    xi = f"atan2({t}, cos({lam}))"
    eta = f"atanh(sin({lam}) / sqrt(1 + ({t}) * ({t})))"
    k = repr(geo.SCALE_K0 * geo.RECTIFYING_RADIUS_M)
    e = eta + "".join(f" + {a!r}::double * cos({2*j} * {xi}) * sinh({2*j} * {eta})" for j, a in enumerate(geo.ALPHA, 1))
    no = xi + "".join(f" + {a!r}::double * sin({2*j} * {xi}) * cosh({2*j} * {eta})" for j, a in enumerate(geo.ALPHA, 1))
    return f"(500000e0 + {k}::double * ({e}))", f"({k}::double * ({no}))"


_X, _Y = utm_sql("lon", "lat")
VIEWS["v_shape"] = f"""
select shape_id, i, lon, lat, {_X} as x, {_Y} as y from (select s.shape_id, i.i,
 -79.38e0 + case when s.shape_id = 'S1' then 2e-3 * (i.i % 2) else 0e0 end as lon, 43.65e0 + 1e-2 * i.i as lat
 from (select distinct shape_id from v_trips) s, (select unnest(generate_series(0, 15)) as i) i)"""
VIEWS["v_seg0"] = """
select shape_id, i as seg_no, lon, lat, lead(lon) over w as lon1, lead(lat) over w as lat1,
 x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1 from v_shape window w as (partition by shape_id order by i)"""
VIEWS["v_polyseg"] = """
select *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as len,
 coalesce(sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))) over (partition by shape_id order by seg_no rows between unbounded preceding and 1 preceding), 0) as cum
from v_seg0 where x1 is not null"""
_PX, _PY = utm_sql("longitude", "latitude")
VIEWS["v_xy"] = f"select *, {_PX} as x, {_PY} as y from v_vp"


def foot(p: str = "p", s: str = "s") -> str:
    return (f"least(1e0, greatest(0e0, (({p}.x - {s}.x0) * ({s}.x1 - {s}.x0) + ({p}.y - {s}.y0) * ({s}.y1 - {s}.y0))"
            f" / (({s}.x1 - {s}.x0) * ({s}.x1 - {s}.x0) + ({s}.y1 - {s}.y0) * ({s}.y1 - {s}.y0))))")


def orth(p: str = "p", s: str = "s") -> str:
    f = foot(p, s)
    return (f"sqrt(pow({p}.x - {s}.x0 - {f} * ({s}.x1 - {s}.x0), 2) + pow({p}.y - {s}.y0 - {f} * ({s}.y1 - {s}.y0), 2))")


# every ping against every segment of its own shape
VIEWS["v_proj"] = f"""
select id, arg_min(along, orth * 1e6 + seg_no * 1e-7) as along, min(orth) as orth from (
 select p.id, s.seg_no, {orth()} as orth, s.cum + {foot()} * s.len as along
 from v_xy p join v_trips t using (trip_id) join v_polyseg s using (shape_id)) group by id"""


@case("p08_lonlat_to_utm17", f"select id, {rs('x')} as x, {rs('y')} as y from v_xy")
def _(spark, d):
    return rounded(shapes.with_xy(fx.vehicle_positions(spark, d)).select("id", "x", "y"))


@case("p08_utm17_to_lonlat", f"select id, {rs('longitude', 6)} as lon, {rs('latitude', 6)} as lat from v_vp")
def _(spark, d):
    xy = shapes.with_xy(fx.vehicle_positions(spark, d))
    lon, lat = geo.utm_lonlat(F.col("x"), F.col("y"))
    return xy.select("id", r(lon, 6).alias("lon"), r(lat, 6).alias("lat"))


def _with_shape(spark, d):
    return tr.attach_static_trip(fx.instances(spark, d).drop("travel_distance_m"), fx.trips(spark, d))


def _segments(spark, d):
    return shapes.shape_segments(fx.shape_points(spark, d))


@case("j04_nearest_on_shape", f"select id, {rs('along', 2)} as along_m, {rs('orth', 2)} as orth_m from v_proj where orth <= 200")
def _(spark, d):
    out = shapes.nearest_on_shape(_with_shape(spark, d), _segments(spark, d))
    return rounded(out.select("id", F.col("travel_distance_m").alias("along_m"), F.col("orthogonal_distance_m").alias("orth_m")), 2)


@case("j04_nearest_on_shape_unpruned", f"select id, {rs('along', 2)} as along_m, {rs('orth', 2)} as orth_m from v_proj")
def _(spark, d):
    out = shapes.nearest_on_shape_unpruned(_with_shape(spark, d), _segments(spark, d))
    return rounded(out.select("id", F.col("travel_distance_m").alias("along_m"), F.col("orthogonal_distance_m").alias("orth_m")), 2)


@case("j05_nearest_among_shapes", f"""
select id, {rs('min(o)', 2)} as shortest_distance_m from (select p.id, {orth()} as o from v_xy p, v_polyseg s) group by id""")
def _(spark, d):
    out = shapes.nearest_of_network(fx.vehicle_positions(spark, d), _segments(spark, d))
    return rounded(out.select("id", "shortest_distance_m"), 2)


@case("j06_point_in_buffer", f"select id from (select p.id, {orth()} as o from v_xy p, v_polyseg s) group by id having min(o) <= 50")
def _(spark, d):
    return shapes.within_corridor(fx.vehicle_positions(spark, d), _segments(spark, d), 50.0).select("id")


@case("j07_lonlat_at_distance", f"""
select trip_id, datetime, {rs('px', 0)} as x, {rs('py', 0)} as y from (
 select t.trip_id, t.t as datetime, s.x0 + least(1e0, (greatest(t.dist, 0) - s.cum) / s.len) * (s.x1 - s.x0) as px,
  s.y0 + least(1e0, (greatest(t.dist, 0) - s.cum) / s.len) * (s.y1 - s.y0) as py
 from v_traj t join v_trips using (trip_id) join v_polyseg s using (shape_id)
 where greatest(t.dist, 0) >= s.cum and (greatest(t.dist, 0) < s.cum + s.len or s.seg_no = 14))""")
def _(spark, d):
    traj = fx.trajectories(spark, d).join(fx.trips(spark, d).select("trip_id", "shape_id"), "trip_id")
    out = shapes.with_xy(shapes.lonlat_at_distance(traj, _segments(spark, d)))
    return rounded(out.select("trip_id", "datetime", "x", "y"), 0)


_CANON = """
select route_id, direction_id, shape_id, min_by(trip_id, sk) as trip_id from (
 select c.route_id, c.direction_id, c.shape_id, t.trip_id, printf('%09d', 1000000 - n) || t.trip_id as sk from
 (select route_id, direction_id, shape_id from (select route_id, direction_id, shape_id, count(*) as k from v_trips group by all)
  qualify row_number() over (partition by route_id, direction_id order by k desc, shape_id) = 1) c
 join v_trips t on t.route_id = c.route_id and t.direction_id = c.direction_id and t.shape_id = c.shape_id
 join (select trip_id, count(*) as n from v_stoptimes group by 1) s on s.trip_id = t.trip_id) group by 1, 2, 3"""
VIEWS["v_canon"] = _CANON.replace("min_by", "arg_min")


@case("a19_canonical_shape", "select * from v_canon")
def _(spark, d):
    return rounded(shapes.canonical_shape(fx.trips(spark, d), fx.stop_times(spark, d)))


_SX, _SY = utm_sql("stop_lon", "stop_lat")
VIEWS["v_stop"] = f"""
select *, {_SX} as x, {_SY} as y from (select 'P' || i.i as stop_id, 'Stop ' || i.i as stop_name, i.i as k,
 43.65e0 + i.i * 500e0 / 111132e0 as stop_lat, -79.38e0 + 2e-4 * (i.i % 3) as stop_lon from (select unnest(generate_series(0, 30)) as i) i)"""
VIEWS["v_stopdist"] = f"""
select c.route_id, c.direction_id, c.shape_id, p.stop_id, p.k,
 arg_min(s.cum + {foot()} * s.len, {orth()} * 1e6 + s.seg_no * 1e-7) as dist
from v_canon c, v_stop p, v_polyseg s where s.shape_id = c.shape_id group by all"""


@case("w05_route_stops", f"select route_id, direction_id, shape_id, stop_id, k as stop_idx, {rs('max(dist) over (partition by route_id, direction_id order by k)', 2)} as distance_m from v_stopdist")
def _(spark, d):
    out = shapes.route_stops(fx.trips(spark, d), fx.stop_times(spark, d), fx.stops(spark, d), _segments(spark, d))
    return rounded(out.select("route_id", "direction_id", "shape_id", "stop_id", "stop_idx", "distance_m"), 2)


@case("w04_monotone_stop_distances", f"""
with proj as (select s.shape_id, p.k, arg_min(s.cum + {foot()} * s.len, {orth()} * 1e6 + s.seg_no * 1e-7) as d from v_stop p, v_polyseg s group by 1, 2),
total as (select shape_id, sum(len) as l from v_polyseg group by 1),
ahead as (select shape_id, k, max(d) over (partition by shape_id order by k) as d from proj)
select shape_id, k, {rs('d', 1)} as distance_m from ahead union all
select shape_id, 61 - k, {rs('case when k = 30 then d else 2 * l - d end', 1)} from ahead join total using (shape_id)""")
def _(spark, d):
    """Out-and-back line per shape: the stops of the way back must not snap to the way out."""
    pts = fx.shape_points(spark, d)
    back = pts.withColumn("shape_pt_sequence", 31 - F.col("shape_pt_sequence"))
    segs = shapes.shape_segments(pts.unionByName(back))
    used = pts.select(F.collect_set("shape_id")).scalar()
    stops = shapes.with_xy(fx.stops(spark, d), "stop_lon", "stop_lat").withColumn("shape_id", F.explode(used))
    visits = stops.withColumn("p", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "o", F.expr("case when p = 0 then 0 else 100 end + cast(substr(stop_id, 2) as int) * case when p = 0 then 1 else -1 end"))
    lists = visits.groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("o", "x", "y"))).alias("stops"))
    out = shapes.monotone_stop_distances(lists, segs)
    return rounded(out.select("shape_id", F.posexplode("distances").alias("k", "distance_m")), 1)


@case("a35_shape_variants", f"""
select v.*, c.shape_id as canonical_shape_id, {rs("sum(case when v.shape_id <> c.shape_id then trips else 0 end) over w / sum(trips) over w")} as non_canonical_share
from (select route_id, direction_id, shape_id, count(*) as trips from v_trips group by all) v
left join v_canon c using (route_id, direction_id) window w as (partition by v.route_id, v.direction_id)""")
def _(spark, d):
    return rounded(shapes.shape_variants(fx.trips(spark, d), fx.stop_times(spark, d)))


_HS = """2 * 6371000e0 * asin(sqrt(pow(sin(radians(lat1 - lat) / 2), 2)
 + cos(radians(lat)) * cos(radians(lat1)) * pow(sin(radians(lon1 - lon) / 2), 2)))"""


@case("a36_shape_length_check", f"""select shape_id, {rs('sum(len)', 2)} as planar_m, {rs(f'sum({_HS})', 2)} as haversine_m,
 {rs(f'abs(sum(len) / sum({_HS}) - 1)', 6)} as abs_error from v_polyseg group by 1""")
def _(spark, d):
    out = shapes.shape_length_check(_segments(spark, d))
    return rounded(out.withColumn("abs_error", r("abs_error", 6)), 2, skip=("abs_error",))


@case("j18_shape_variant_compare", f"""
with var as (select t.route_id, t.direction_id, t.shape_id as vs, c.shape_id as cs, t.trip_id from v_trips t join v_canon c using (route_id, direction_id) where t.shape_id <> c.shape_id),
pick as (select route_id, direction_id, vs, cs, min(trip_id) as trip_id, 'P0' as stop_id from var group by 1, 2, 3, 4),
proj as (select s.shape_id, p.stop_id, arg_min(s.cum + {foot()} * s.len, {orth()} * 1e6 + s.seg_no * 1e-7) as m from v_stop p, v_polyseg s group by 1, 2)
select route_id, direction_id, vs as variant_shape_id, cs as canonical_shape_id, trip_id, pick.stop_id, {rs('a.m', 2)} as variant_m, {rs('b.m', 2)} as canonical_m, {rs('abs(a.m - b.m)', 2)} as difference_m
from pick join proj a on a.shape_id = vs and a.stop_id = pick.stop_id join proj b on b.shape_id = cs and b.stop_id = pick.stop_id""")
def _(spark, d):
    out = shapes.shape_variant_compare(fx.trips(spark, d), fx.stop_times(spark, d), fx.stops(spark, d), _segments(spark, d))
    return rounded(out, 2)


@case("a44_stop_order_check", """select route_id, direction_id, bool_and(p is null or k > p) as sequence_ok, true as index_ok
 from (select *, lag(k) over (partition by route_id, direction_id order by dist, k) as p from (select distinct route_id, direction_id, k, dist from v_stopdist)) group by 1, 2""")
def _(spark, d):
    rs_ = shapes.route_stops(fx.trips(spark, d), fx.stop_times(spark, d), fx.stops(spark, d), _segments(spark, d))
    return rounded(shapes.stop_order_check(rs_))


# full chain: guard, dedup, projection, cutoff, teleport fold, speed, grid
_CHAIN = """
bad as (select k.trip_id, k.start_date from (select trip_id, start_date, any_value(route_id) as rt from v_vp group by all) k join v_trips t using (trip_id) where t.route_id <> k.rt),
ordered as (select i.*, p.along, t.shape_id, row_number() over (partition by i.trip_id, i.start_date order by i.dt_s) as rn
 from v_inst i join v_proj p using (id) join v_trips t using (trip_id)
 where p.orth <= 200 and not exists (select 1 from bad b where b.trip_id = i.trip_id and b.start_date = i.start_date)),
fold as (select trip_id, start_date, rn, id, true as keep, dt_s as at, along as ad from ordered where rn = 1
 union all
 select o.trip_id, o.start_date, o.rn, o.id, abs(o.along - f.ad) <= 35e0 * (o.dt_s - f.at),
  case when abs(o.along - f.ad) <= 35e0 * (o.dt_s - f.at) then o.dt_s else f.at end,
  case when abs(o.along - f.ad) <= 35e0 * (o.dt_s - f.at) then o.along else f.ad end
 from fold f join ordered o on o.trip_id = f.trip_id and o.start_date = f.start_date and o.rn = f.rn + 1),
kept as (select * from ordered where id in (select id from fold where keep)),
sp as (select *, coalesce((along - lag(along) over w) / (dt_s - lag(dt_s) over w), 0e0) as v from kept window w as (partition by trip_id, start_date order by dt_s)),
pr as (select *, lead(dt_s) over w as t2, lead(along) over w as a2, lead(v) over w as vv, lead(id) over w as id2 from sp window w as (partition by trip_id, start_date order by dt_s)),
up as (select *, unnest(generate_series(((dt_s + 9) // 10) * 10, t2 - 1, 10)) as g from pr where t2 is not null),
fin as (select *, along + (g - dt_s)::double * vv as gd from up)
"""


def _chain(tail: str) -> str:
    head = with_views("select 1 from v_inst, v_proj, v_trips")
    head = head[: head.rindex("select 1 from v_inst")].rstrip().replace("with ", "with recursive ", 1)
    return f"{head}, {_CHAIN} {tail}"


@case("c01_build_trajectories")
def _(spark, d):
    out = plan.build_trajectories(fx.vehicle_positions(spark, d), fx.trips(spark, d), fx.shape_points(spark, d))
    return rounded(out.select("trip_id", "start_date", "service_date", "shape_id", "datetime", "travel_distance_m", "moving_speed_m_s",
                              "time_offset_seconds"), 1)


ORACLES["c01_build_trajectories"] = _chain(f"""
select trip_id, start_date, start_date as service_date, shape_id, g as datetime, {rs('round_even(gd * 100, 0)::double / 100', 1)} as travel_distance_m,
 {rs('round_even(vv * 100, 0)::double / 100', 1)} as moving_speed_m_s, case when feed_date is not null then g - (1704067200 + 18000 + (6 + user_id % 20) * 3600 + 900) end as time_offset_seconds from fin""")


@case("c01_run_service_dates")
def _(spark, d):
    """All service dates run into the stored table under a ledger, then one of them again; the answer is the table's."""
    vp, trips, points = (materialise(x, "input") for x in (fx.vehicle_positions(spark, d), fx.trips(spark, d), fx.shape_points(spark, d)))
    path, ledger = shared_dir(spark, "trajectories"), shared_dir(spark, "ledger")
    days = [f"{x[:4]}-{x[4:6]}-{x[6:]}" for x in sorted(r[0] for r in tr.with_instance(vp).select("start_date").distinct().collect())]
    plan.run_service_dates(vp, trips, points, path, ledger, days)
    plan.run_service_dates(vp, trips, points, path, ledger, days[:1])
    return rounded(store.read_trajectories(spark, path).select("trip_id", "start_date", "service_date", "shape_id", "datetime", "travel_distance_m",
                                                               "moving_speed_m_s", "time_offset_seconds"), 1)


ORACLES["c01_run_service_dates"] = ORACLES["c01_build_trajectories"]


def _audit_points(spark, d):
    unique = tr.dedup_instance_times(fx.instances(spark, d).drop("travel_distance_m"))
    return tr.attach_static_trip(unique, fx.trips(spark, d))


@case("a28_filter_drop_rates")
def _(spark, d):
    vp = fx.instances(spark, d).drop("travel_distance_m")
    return rounded(audit.filter_drop_rates(vp, fx.trips(spark, d), _segments(spark, d)))


ORACLES["a28_filter_drop_rates"] = _chain(f"""
select (select count(*) from v_vp) - (select count(*) from v_inst) as dropped_dedup, n as projected,
 n - o as dropped_off_route, o - k as dropped_teleport, {rs('100e0 * (n - o) / n')} as off_route_pct, {rs('100e0 * (o - k) / n')} as teleport_pct
from (select (select count(*) from v_inst) as n, (select count(*) from v_inst join v_proj using (id) where orth <= 200) as o, (select count(*) from fold where keep) as k)
""").replace(" and not exists (select 1 from bad b where b.trip_id = i.trip_id and b.start_date = i.start_date)", "")


@case("a29_orthogonal_profile", f"""
select {', '.join(f"{rs(f'quantile_cont(o, {p})', 2)} as p{n}" for n, p in ((50, .5), (90, .9), (95, .95), (99, .99)))},
 {rs('max(o)', 2)} as max_m, {rs('100e0 * count(*) filter (where orth > 200) / count(*)')} as beyond_pct
from (select orth, orth as o from v_inst join v_proj using (id))""")
def _(spark, d):
    out = audit.orthogonal_profile(shapes.projection_audit(_audit_points(spark, d), _segments(spark, d)))
    return rounded(out.withColumn("beyond_pct", r("beyond_pct")), 2, skip=("beyond_pct",))


@case("a45_wrong_shape_distance", f"""
select i.trip_id, i.start_date, {rs('quantile_cont(orth, 0.5)', 2)} as median_m, count(*) as points, count(*) filter (where orth <= 200) as kept
from v_inst i join v_proj using (id) join v_trips t using (trip_id) where t.route_id <> i.route_id group by 1, 2""")
def _(spark, d):
    return rounded(audit.wrong_shape_distance(fx.instances(spark, d).drop("travel_distance_m"), fx.trips(spark, d), _segments(spark, d)), 2)
