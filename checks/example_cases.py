"""Grid, leaders, headways and labelled windows (history 5, horizon 5, step 60 s)."""

from pyspark.sql import functions as F

from tramline.operators import buses, detect, examples as ex
from tramline.sources import store

from . import fixtures as fx
from .registry import case, r, rounded, rs
from .sql_views import VIEWS

L = H = 5
_SL = "service_date, route_id, direction_id"

VIEWS["v_grid"] = f"""
select {_SL}, bus_index, trip_id, k.k as k,
 case when k.k * 60 = t then dist else p_d + (k.k * 60 - p_t)::double / (t - p_t) * (dist - p_d) end as dist,
 case when k.k * 60 = t then speed else p_v + (k.k * 60 - p_t)::double / (t - p_t) * (speed - p_v) end as speed,
 case when k.k * 60 = t then stop_index else p_s + (k.k * 60 - p_t)::double / (t - p_t) * (stop_index - p_s) end as stop
from (select *, lag(t) over w as p_t, lag(dist) over w as p_d, lag(speed) over w as p_v, lag(stop_index) over w as p_s from v_bus
  window w as (partition by {_SL}, bus_index order by t)),
 lateral (select unnest(generate_series(coalesce(p_t // 60 + 1, (t + 59) // 60), t // 60)) as k) k
where p_t is null or least(k.k * 60 - p_t, t - k.k * 60) <= 120"""
VIEWS["v_ranked"] = f"""
select *, dense_rank() over (partition by {_SL}, k order by dist) as rk from v_grid"""
VIEWS["v_dist"] = f"""
select {_SL}, k, rk, min(dist) as dist, arg_min(speed, bus_index) as speed, min(bus_index) as leader from v_ranked group by all"""
VIEWS["v_chain"] = f"""
select g.*, coalesce(a.dist - g.dist, 20000e0) as gap, coalesce(a.speed, 0e0) as d1v, coalesce(b.dist - a.dist, 20000e0) as d1g,
 coalesce(b.speed, 0e0) as d2v, coalesce(c.dist - b.dist, 20000e0) as d2g, a.leader
from v_ranked g
left join v_dist a on a.service_date = g.service_date and a.route_id = g.route_id and a.direction_id = g.direction_id and a.k = g.k and a.rk = g.rk + 1
left join v_dist b on b.service_date = g.service_date and b.route_id = g.route_id and b.direction_id = g.direction_id and b.k = g.k and b.rk = g.rk + 2
left join v_dist c on c.service_date = g.service_date and c.route_id = g.route_id and c.direction_id = g.direction_id and c.k = g.k and c.rk = g.rk + 3"""
VIEWS["v_pass"] = f"""
select {_SL}, bus_index, k, max(dist) over (partition by {_SL}, bus_index order by k) as cm, count(*) over (partition by {_SL}, bus_index) as n from v_grid"""
VIEWS["v_asked"] = f"""
select q.service_date, q.route_id, q.direction_id, q.bus_index, q.k, q.dist,
 min(case when t.cm >= q.dist then t.k end) as ka, max(case when t.cm < q.dist then t.k end) as kb,
 min(case when t.cm >= q.dist then t.cm end) as da, max(case when t.cm < q.dist then t.cm end) as db
from v_chain q join v_pass t on t.service_date = q.service_date and t.route_id = q.route_id and t.direction_id = q.direction_id and t.bus_index = q.leader and t.n >= 2
group by all"""
VIEWS["v_head"] = f"""
select c.*, case when a.ka is null then null when a.kb is null then case when a.da = c.dist then (c.k - a.ka) * 60e0 end
 else (c.k - (a.kb + (c.dist - a.db) / (a.da - a.db) * (a.ka - a.kb))) * 60 end as hw
from v_chain c left join v_asked a using ({_SL}, bus_index, k)"""
VIEWS["v_ref"] = f"""
select r.* from v_head r where stop >= 2 and stop < 29
 and (select count(*) from v_chain h where h.service_date = r.service_date and h.route_id = r.route_id and h.direction_id = r.direction_id and h.bus_index = r.bus_index and h.k between r.k - 4 and r.k) = 5
 and (select min(gap) from v_chain h where h.service_date = r.service_date and h.route_id = r.route_id and h.direction_id = r.direction_id and h.bus_index = r.bus_index and h.k between r.k - 4 and r.k) < 20000"""


def _num(df, pts):
    return buses.number_buses(df, pts)


@case("w25_grid_track", f"select {_SL}, bus_index, k, {rs('dist')} as dist, {rs('speed')} as speed, {rs('stop')} as stop from v_grid")
def _(spark, d):
    pts = fx.bus_points(spark, d)
    return rounded(_num(ex.grid_track(pts), pts).select(*buses.SLICE, "bus_index", "k", F.col("dist_m").alias("dist"), "speed", F.col("stop_index").alias("stop")))


@case("j15_nearest_sample", f"""
select {_SL}, bus_index, k.k as k, arg_min(t, abs(k.k * 45 - t) * 1000000::hugeint * 1000000 + t) as sample_t
from v_bus, lateral (select unnest(generate_series((t - 60) // 45, (t + 60) // 45 + 1)) as k) k
where abs(k.k * 45 - t) <= 50 group by all""")
def _(spark, d):
    pts = fx.bus_points(spark, d)
    stamped = pts.withColumn("travel_distance_m", F.unix_micros("datetime") / 1e6)
    out = ex.grid_track(stamped, 45, 50.0, sampling="nearest")
    return rounded(_num(out, pts).select(*buses.SLICE, "bus_index", "k", F.col("dist_m").cast("bigint").alias("sample_t")))


def _chain(spark, d):
    pts = fx.bus_points(spark, d)
    return pts, ex.leader_chain(ex.grid_track(pts))


@case("j16_leader_at_tick", f"select {_SL}, bus_index, k, {rs('gap')} as gap, {rs('d1v')} as leader_speed from v_chain")
def _(spark, d):
    pts, c = _chain(spark, d)
    return rounded(_num(c, pts).select(*buses.SLICE, "bus_index", "k", F.col("fwd_gap_m").alias("gap"), F.col("d1_speed").alias("leader_speed")))


@case("w26_leader_chain", f"select {_SL}, bus_index, k, {', '.join(f'{rs(c)} as {c}' for c in ('gap', 'd1v', 'd1g', 'd2v', 'd2g'))} from v_chain")
def _(spark, d):
    pts, c = _chain(spark, d)
    return rounded(_num(c, pts).select(*buses.SLICE, "bus_index", "k", F.col("fwd_gap_m").alias("gap"), F.col("d1_speed").alias("d1v"),
                                       F.col("d1_gap_m").alias("d1g"), F.col("d2_speed").alias("d2v"), F.col("d2_gap_m").alias("d2g")))


@case("j17_follower_pair_at_tick", f"""
select {_SL}, bus_index, k, {rs('coalesce(dist - d1, 20000e0)')} as u1_gap, {rs('coalesce(v1, 0e0)')} as u1_speed, {rs('coalesce(dist - d2, 20000e0)')} as u2_gap, {rs('coalesce(v2, 0e0)')} as u2_speed
from (select g.service_date, g.route_id, g.direction_id, g.bus_index, g.k, g.dist, max(case when o.rn = 1 then o.dist end) as d1, max(case when o.rn = 1 then o.speed end) as v1,
  max(case when o.rn = 2 then o.dist end) as d2, max(case when o.rn = 2 then o.speed end) as v2
 from v_grid g left join (select a.service_date, a.route_id, a.direction_id, a.bus_index, a.k, b.dist, b.speed,
   row_number() over (partition by a.service_date, a.route_id, a.direction_id, a.bus_index, a.k order by b.dist desc, b.bus_index) as rn
   from v_grid a join v_grid b on a.service_date = b.service_date and a.route_id = b.route_id and a.direction_id = b.direction_id and a.k = b.k and b.dist < a.dist) o
 using ({_SL}, bus_index, k) group by all)""")
def _(spark, d):
    pts = fx.bus_points(spark, d)
    out = ex.follower_pair(ex.grid_track(pts))
    return rounded(_num(out, pts).select(*buses.SLICE, "bus_index", "k", F.col("u1_gap_m").alias("u1_gap"), "u1_speed", F.col("u2_gap_m").alias("u2_gap"), "u2_speed"))


@case("w27_passage_headway", f"select {_SL}, bus_index, k, {rs('hw', 2)} as headway_s from v_head")
def _(spark, d):
    pts, c = _chain(spark, d)
    return rounded(_num(ex.passage_headway(c), pts).select(*buses.SLICE, "bus_index", "k", "headway_s"), 2)


@case("w28_history_window", f"""
select r.service_date, r.route_id, r.direction_id, r.bus_index, r.k, h.k - r.k + 4 as tick, {rs('h.speed')} as v, {rs('h.gap')} as gap, {rs('h.d1v')} as d1v, {rs('h.d1g')} as d1g, {rs('h.d2v')} as d2v, {rs('h.d2g')} as d2g
from v_ref r join v_chain h on h.service_date = r.service_date and h.route_id = r.route_id and h.direction_id = r.direction_id and h.bus_index = r.bus_index and h.k between r.k - 4 and r.k""")
def _(spark, d):
    pts, c = _chain(spark, d)
    rows = ex.history_window(c, L)
    x = rows.select(*buses.SLICE, "bus_id", "k", F.posexplode(ex.window_channels(F.col("hist"))).alias("tick", "x"))
    return rounded(_num(x, pts).select(*buses.SLICE, "bus_index", "k", "tick", *[F.col("x")[i].alias(n) for i, n in enumerate(("v", "gap", "d1v", "d1g", "d2v", "d2g"))]))


_NEAR = "h.service_date = r.service_date and h.route_id = r.route_id and h.direction_id = r.direction_id and h.bus_index = r.bus_index"
_MIN = "(((h.k * 60 - 18000) % 86400) / 60e0)"


@case("w29_context_features", f"""
select service_date, route_id, direction_id, bus_index, k, tick, {rs('stop / 31')} as stop_norm,
 {rs('case when lb > 0 and gp < 20000 and gap < 20000 then (gp - gap) / (lb * 60) else 0e0 end', 4)} as closing,
 {rs('sin(2 * pi() * m / 1440)')} as tod_sin, {rs('cos(2 * pi() * m / 1440)')} as tod_cos, {rs('case when d1v <> 0 then speed - d1v else 0e0 end')} as rel_speed,
 {rs('case when tick >= 3 then (speed - v3) / 180e0 else 0e0 end', 5)} as accel
from (select r.service_date, r.route_id, r.direction_id, r.bus_index, r.k, h.k - r.k + 4 as tick, h.stop, h.gap, h.speed, h.d1v, {_MIN} as m, least(3, h.k - r.k + 4) as lb,
  (select g.gap from v_chain g where g.service_date = r.service_date and g.route_id = r.route_id and g.direction_id = r.direction_id and g.bus_index = r.bus_index and g.k = h.k - least(3, h.k - r.k + 4)) as gp,
  (select g.speed from v_chain g where g.service_date = r.service_date and g.route_id = r.route_id and g.direction_id = r.direction_id and g.bus_index = r.bus_index and g.k = h.k - 3) as v3
 from v_ref r join v_chain h on {_NEAR} and h.k between r.k - 4 and r.k)""")
def _(spark, d):
    pts, c = _chain(spark, d)
    rows = ex.history_window(c, L)
    x = rows.select(*buses.SLICE, "bus_id", "k", F.posexplode(ex.context_features(4, L)).alias("tick", "x"))
    names = ("stop_norm", "closing", "tod_sin", "tod_cos", "rel_speed", "accel")
    digits = {"closing": 4, "accel": 5}
    return rounded(_num(x, pts).select(*buses.SLICE, "bus_index", "k", "tick", *[r(F.col("x")[i], digits.get(n, 3)).alias(n) for i, n in enumerate(names)]), skip=names)


@case("w29_context_layout_1", f"""
select service_date, route_id, direction_id, bus_index, k, tick, {rs('stop')} as stop_index, {rs('stop / 31')} as stop_norm,
 {rs('case when lb > 0 and gp < 20000 and gap < 20000 then (gp - gap) / (lb * 60) else 0e0 end', 4)} as closing, {rs('d1v')} as leader_speed, {rs('slow * 60e0')} as dwell,
 {rs('sin(2 * pi() * m / 1440)')} as tod_sin, {rs('cos(2 * pi() * m / 1440)')} as tod_cos
from (select r.service_date, r.route_id, r.direction_id, r.bus_index, r.k, h.k - r.k + 4 as tick, h.stop, h.gap, h.speed, h.d1v, {_MIN} as m, least(3, h.k - r.k + 4) as lb,
  (select g.gap from v_chain g where g.service_date = r.service_date and g.route_id = r.route_id and g.direction_id = r.direction_id and g.bus_index = r.bus_index and g.k = h.k - least(3, h.k - r.k + 4)) as gp,
  (select count(*) from v_chain g where g.service_date = r.service_date and g.route_id = r.route_id and g.direction_id = r.direction_id and g.bus_index = r.bus_index and g.k between r.k - 4 and h.k and g.speed < 5e-1) as slow
 from v_ref r join v_chain h on {_NEAR} and h.k between r.k - 4 and r.k)""")
def _(spark, d):
    pts, c = _chain(spark, d)
    rows = ex.history_window(c, L, layout=1)
    x = rows.select(*buses.SLICE, "bus_id", "k", F.posexplode(ex.context_features(1, L)).alias("tick", "x"))
    names = ("stop_index", "stop_norm", "closing", "leader_speed", "dwell", "tod_sin", "tod_cos")
    return rounded(_num(x, pts).select(*buses.SLICE, "bus_index", "k", "tick", *[r(F.col("x")[i], 4 if n == "closing" else 3).alias(n) for i, n in enumerate(names)]), skip=names)


VIEWS["v_lab"] = f"""
select r.service_date, r.route_id, r.direction_id, r.bus_index, r.k, o.o as h, f.gap, f.hw, f.stop, f.stop >= 2 and f.stop < 29 as band,
 (select count(*) from v_chain x where x.service_date = r.service_date and x.route_id = r.route_id and x.direction_id = r.direction_id and x.bus_index = r.bus_index and x.k between r.k + 1 and r.k + o.o) = o.o as walk,
 p.gap as prev_gap
from v_ref r cross join (select unnest(generate_series(1, 5)) as o) o
left join v_head f on f.service_date = r.service_date and f.route_id = r.route_id and f.direction_id = r.direction_id and f.bus_index = r.bus_index and f.k = r.k + o.o
left join v_chain p on p.service_date = r.service_date and p.route_id = r.route_id and p.direction_id = r.direction_id and p.bus_index = r.bus_index and p.k = r.k + o.o - 1"""
VIEWS["v_lab2"] = """
select *, case when walk and band then (gap < 100)::int::double end as y, case when walk and band then gap end as g, case when walk and band then hw end as head,
 case when walk and band then case when prev_gap is null then (gap < 100)::int::double else (gap < 100 and prev_gap < 100)::int::double end end as p from v_lab"""


def _examples(spark, d):
    pts = fx.bus_points(spark, d)
    return pts, ex.labelled_examples(pts, L, H)


@case("w30_horizon_labels", f"select {_SL}, bus_index, k, h, y, {rs('g')} as gap, p, {rs('head', 2)} as headway_s from v_lab2")
def _(spark, d):
    pts, e = _examples(spark, d)
    z = F.arrays_zip("labels", "label_gaps", "labels_persist", "labels_headway_s")
    x = e.select(*buses.SLICE, "bus_id", "k", F.posexplode(z).alias("h", "z"))
    return rounded(_num(x, pts).select(*buses.SLICE, "bus_index", "k", (F.col("h") + 1).alias("h"), F.col("z.labels").alias("y"), F.col("z.label_gaps").alias("gap"),
                                       F.col("z.labels_persist").alias("p"), r("z.labels_headway_s", 2).alias("headway_s")), skip=("headway_s",))


@case("a39_label_profile", f"""
select h, count(*) as n, {rs('avg(y)')} as positive_rate, {rs('avg((y is null)::int)')} as missing_rate,
 count(*) filter (where y is null and h < last) as interior_missing, count(*) filter (where y is null and h > last) as trailing_missing, sum(y) as positives, sum(p) as positives_debounced
from (select *, coalesce(max(case when y is not null then h end) over (partition by {_SL}, bus_index, k), 0) as last from v_lab2) group by h""")
def _(spark, d):
    return rounded(ex.label_profile(_examples(spark, d)[1]))


@case("m28_headway_ratio_label", f"""
select {_SL}, bus_index, k, h, case when head is not null and sched is not null then (head <= 25e-2 * sched)::int::double end as y
from v_lab2 join (select distinct service_date, route_id, direction_id, bus_index, trip_id from v_bus) using ({_SL}, bus_index)
left join (select service_date, route_id, direction_id, trip_id, hw as sched from v_sched) using ({_SL}, trip_id)""")
def _(spark, d):
    from tramline.sources import timetable as tt

    from .timetable_cases import _slice_services

    pts = fx.bus_points(spark, d)
    sv = _slice_services(spark, d)
    hw = tt.scheduled_headway(tt.trip_starts(fx.stop_times(spark, d), fx.trips(spark, d)), sv, sv.select("service_date"))
    e = ex.labelled_examples(pts, L, H, headways=hw)
    y = ex.headway_ratio_labels(F.col("labels_headway_s"), F.col("sched_headway_s"))
    x = e.select(*buses.SLICE, "bus_id", "k", F.posexplode(y).alias("h", "y"))
    return rounded(_num(x, pts).select(*buses.SLICE, "bus_index", "k", (F.col("h") + 1).alias("h"), "y"))


VIEWS["v_split"] = """
select day, case when i <= greatest(1, round_even(n * 0.7, 0)) then 'train'
 when i <= greatest(1, round_even(n * 0.7, 0)) + case when n - greatest(1, round_even(n * 0.7, 0)) > 1 then greatest(1, round_even(n * 0.15, 0)) else 0 end then 'val' else 'test' end as split
from (select day, row_number() over (order by day) as i, count(*) over () as n from (select distinct ts::date as day from events))"""


@case("w31_date_split", "select strftime(day, '%Y%m%d') as service_date, split from v_split")
def _(spark, d):
    days = fx.table(spark, d, "events").select(F.to_date("ts").alias("service_date"))
    return rounded(store.date_split(days))


@case("s14_write_example_shards", f"select service_date, direction_id, count(*) as n_examples from v_ref group by 1, 2")
def _(spark, d):
    from tramline.session import shared_dir

    folder = shared_dir(spark, "examples")
    store.write_example_shards(_examples(spark, d)[1], folder)
    return rounded(spark.read.schema("service_date date, direction_id int, n_examples bigint").json(f"{folder}/manifest"))


@case("s15_scan_example_split", "select split, count(*) as n from v_split join events on ts::date = day group by 1")
def _(spark, d):
    from tramline.session import shared_dir

    folder = shared_dir(spark, "examples")
    ev = fx.table(spark, d, "events").select(F.to_date("ts").alias("service_date"), F.lit(0).alias("direction_id"), "event_id")
    store.write_example_shards(ev, folder)
    parts = [store.scan_example_split(spark, folder, s).agg(F.count("*").alias("n")).select(F.lit(s).alias("split"), "n") for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_CHANNELS = (*ex.CHANNELS[2], *ex.CONTEXT[4])
VIEWS["v_channels"] = f"""
select row_number() over () as id, tick, [speed, gap, d1v, d1g, d2v, d2g, stop / 31, case when lb > 0 and gp < 20000 and gap < 20000 then (gp - gap) / (lb * 60) else 0e0 end,
 sin(2 * pi() * m / 1440), cos(2 * pi() * m / 1440), case when d1v <> 0 then speed - d1v else 0e0 end, case when tick >= 3 then (speed - v3) / 180e0 else 0e0 end] as x
from (select r.k, h.k - r.k + 4 as tick, h.stop, h.gap, h.speed, h.d1v, h.d1g, h.d2v, h.d2g, {_MIN} as m, least(3, h.k - r.k + 4) as lb,
  (select g.gap from v_chain g where g.service_date = r.service_date and g.route_id = r.route_id and g.direction_id = r.direction_id and g.bus_index = r.bus_index and g.k = h.k - least(3, h.k - r.k + 4)) as gp,
  (select g.speed from v_chain g where g.service_date = r.service_date and g.route_id = r.route_id and g.direction_id = r.direction_id and g.bus_index = r.bus_index and g.k = h.k - 3) as v3
 from v_ref r join v_chain h on {_NEAR} and h.k between r.k - 4 and r.k)"""


@case("a42_channel_correlation", f"""
select names[i] as a, names[j] as b, {rs('mean')} as corr, abs(mean) >= 8e-1 as strong from (select {list(_CHANNELS)} as names), (
 select i, j, avg(case when c is null or isnan(c) then 0e0 else c end) as mean from (
  select tick, i, j, corr(x[i], x[j]) as c from v_channels, (select unnest(range(1, 13)) as i) i, (select unnest(range(1, 13)) as j) j where i < j group by all) group by i, j)""")
def _(spark, d):
    return rounded(ex.window_pairs_correlation(_examples(spark, d)[1], _CHANNELS))


@case("c04_build_examples", f"""
select {_SL}, bus_index, k, {rs('hw', 2)} as headway_at_ref_s, {rs('gap')} as forward_gap_at_ref, {rs('stop')} as stop_idx_at_ref from v_ref""")
def _(spark, d):
    from tramline.plans import forecasting

    pts = fx.bus_points(spark, d)
    e = forecasting.build_examples(fx.trajectories(spark, d), fx.route_stops(spark, d), length=L, horizon=H, stale_s=330.0)
    return rounded(_num(e, pts).select(*buses.SLICE, "bus_index", "k", r("headway_at_ref_s", 2).alias("headway_at_ref_s"), "forward_gap_at_ref", "stop_idx_at_ref"), skip=("headway_at_ref_s",))


@case("c04_build_dataset", """
with dates as (select service_date, count(*) as n_examples from v_ref group by 1), sized as (select count(*) as n from dates),
cut as (select greatest(1, round_even(n * 7e-1, 0))::int as a, case when n - greatest(1, round_even(n * 7e-1, 0)) > 1 then greatest(1, round_even(n * 15e-2, 0))::int else 0 end as b from sized)
select service_date, n_examples, case when i < a then 'train' when i < a + b then 'val' else 'test' end as split, n_examples as scanned
from (select *, row_number() over (order by service_date) - 1 as i from dates), cut""")
def _(spark, d):
    """Shards, manifest and split on disk; each split is read back by its own scan."""
    from tramline.plans import forecasting
    from tramline.session import shared_dir

    folder = shared_dir(spark, "dataset")
    split = forecasting.build_dataset(fx.trajectories(spark, d), fx.route_stops(spark, d), folder, length=L, horizon=H, stale_s=330.0)
    scans = None
    for name in ("train", "val", "test"):
        part = store.scan_example_split(spark, folder, name).groupBy("service_date").agg(F.count("*").alias("scanned")).withColumn("split", F.lit(name))
        scans = part if scans is None else scans.unionByName(part)
    return rounded(split.join(scans, ["service_date", "split"], "left").select("service_date", "n_examples", "split", "scanned"))
