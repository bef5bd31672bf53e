"""Calendars, headways, labels, metrics and the spread-out sequence helpers."""

import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import examples as ex
from tramline.operators import learn, scoring as sc
from tramline.operators.sequence import cumulative_by_value, previous_in_chunks
from tramline.session import shared_dir
from tramline.sources import feeds, timetable as tt

from test_slices import BASE, group


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def bundle(spark):
    week = {d: 1 for d in ("monday", "tuesday", "wednesday", "thursday", "friday")}
    cal = frame(spark, [("wk", 1, 1, 1, 1, 1, 0, 0, "20260601", "20260630"), ("sat", 0, 0, 0, 0, 0, 1, 0, "20260601", "20260630")],
                "service_id string, " + ", ".join(f"{d} int" for d in [*week, "saturday", "sunday"]) + ", start_date string, end_date string")
    exc = frame(spark, [("wk", "20260610", 2), ("sat", "20260610", 1)], "service_id string, date string, exception_type int")
    return cal, exc


def test_active_services(spark):
    cal, exc = bundle(spark)
    days = frame(spark, [("2026-06-09",), ("2026-06-10",), ("2026-06-13",), ("2026-07-07",)], "d string").select(F.to_date("d").alias("service_date"))
    got = {}
    for r in tt.active_services(cal, exc, days).collect():
        got.setdefault(str(r["service_date"]), set()).add(r["service_id"])
    assert got == {"2026-06-09": {"wk"}, "2026-06-10": {"sat"}, "2026-06-13": {"sat"}}


def test_calendar_unknown_is_not_empty(spark):
    assert tt.scan_calendars(spark, shared_dir(spark, "nothing"))[2] is False


def test_scheduled_headways(spark):
    starts = frame(spark, [("t1", "R", 0, "wk", 100), ("t2", "R", 0, "wk", 460), ("t3", "R", 0, "wk", 1180), ("t5", "R", 0, "sat", 0), ("t6", "R", 0, "sat", 1200)],
                   "trip_id string, route_id string, direction_id int, service_id string, start_s int")
    day = frame(spark, [("2026-06-09",)], "d string").select(F.to_date("d").alias("service_date"))
    services = day.withColumn("service_id", F.lit("wk"))
    got = {r["trip_id"]: r["sched_headway_s"] for r in tt.scheduled_headway(starts, services, day).collect()}
    assert got == {"t2": 360.0, "t3": 720.0}
    assert tt.scheduled_headway(starts, None, day).count() == 4


def test_scan_keeps_ids_as_text_and_adds_missing_columns(spark):
    folder = shared_dir(spark, "gtfs")
    frame(spark, [("007", "29", "x")], "trip_id string, route_id string, junk string").write.option("header", True).csv(f"{folder}/trips.txt")
    row = tt.scan_table(spark, folder, "trips").first()
    assert row.asDict() == {"trip_id": "007", "route_id": "29", "service_id": None, "direction_id": None, "shape_id": None}
    assert tt.scan_feed_info(spark, folder).first().asDict() == {"feed_version": None, "feed_start_date": None, "feed_end_date": None}


def test_allowlist(spark):
    df = frame(spark, [("vehicle_positions", "29"), ("vehicle_positions", None), ("vehicle_positions", "7"), ("subway_trip_updates", "1")], "feed_name string, route_id string")
    kept = lambda routes: sorted(str(r["route_id"]) for r in feeds.route_allowlist_filter(df, routes).collect())
    assert kept(["29"]) == ["1", "29"] and len(kept([])) == 4 and len(kept(None)) == 4
    assert kept(frame(spark, [("29",)], "r string")) == ["1", "29"]
    assert len(kept(frame(spark, [], "r string"))) == 4


def chain(spark, data):
    return ex.leader_chain(ex.grid_track(group(spark, data)))


def run(trip, d0, seconds=3000, v=8.0, hole=None):
    return [(trip, trip, t, d0 + t * v, v) for t in range(0, seconds + 1, 30) if not (hole and hole[0] < t < hole[1])]


def test_headway_of_a_steady_pair(spark):
    got = [r["headway_s"] for r in ex.passage_headway(chain(spark, run("L", 600, 1500) + run("F", 0, 1500))).filter("bus_id like 'F%' and headway_s is not null").collect()]
    assert got and all(abs(h - 75) < 1 for h in got)


def test_labels_stop_at_a_hole_or_skip_it(spark):
    # F has no samples for ten minutes, L is there throughout
    data = run("L", 3000, 3000, 2.0) + run("F", 2000, 3000, 2.0, hole=(900, 1600))
    c = ex.passage_headway(chain(spark, data))
    k0 = (BASE + 600) // 60
    pick = lambda **o: ex.horizon_labels(c, 20, **o).filter(F.col("bus_id").startswith("F") & (F.col("k") == k0)).first()["labels"]
    stop, skip = pick(), pick(on_hole="skip")
    n = next(i for i, y in enumerate(stop) if y is None)
    assert all(y is None for y in stop[n:]) and stop[:n] == skip[:n]
    assert any(y is not None for y in skip[n:])


def test_one_tick_dip_is_debounced(spark):
    # the gap is 300 m but for one grid tick
    lead = [("L", "L", t, 3000 + t * 2.0, 2.0) for t in range(0, 1801, 60)]
    follow = [("F", "F", t, 3000 + t * 2.0 - (50 if (BASE + t) // 60 == (BASE + 900) // 60 else 300), 2.0) for t in range(0, 1801, 60)]
    e = ex.labelled_examples(group(spark, lead + follow), 5, 10).filter(F.col("bus_id").startswith("F"))
    sums = e.select(F.explode(F.arrays_zip("labels", "labels_persist")).alias("z")).agg(F.sum("z.labels"), F.sum("z.labels_persist")).first()
    assert sums[0] > 0 and sums[1] == 0


def test_front_bus_alone_has_no_examples(spark):
    assert ex.labelled_examples(group(spark, run("L", 600, 1500)), 5, 5).count() == 0


def scores(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.choice([0.0, 0.0, 0.0, 1.0, None])
        p = round(min(0.999, max(0.0, rng.gauss(0.55 if y else 0.35, 0.2))), 3)
        rows.append((i, 1, p, y))
    return rows, frame(spark, rows, "example_id long, h int, p double, y double")


def test_average_precision_and_recall_floor(spark):
    rows, df = scores(spark)
    known = [(p, y) for _, _, p, y in rows if y is not None]
    pos = sum(y for _, y in known)
    area, tp, n, last, best = 0.0, 0, 0, 0.0, None
    for p in sorted({p for p, _ in known}, reverse=True):
        here = [y for q, y in known if q == p]
        tp, n = tp + sum(here), n + len(here)
        area += (tp / pos - last) * tp / n
        last = tp / pos
        if tp / n >= 0.4:
            best = max(best or 0.0, tp / pos)
    assert sc.average_precision(df).first()["pr_auc"] == pytest.approx(area)
    assert sc.recall_at_precision(df, [0.4]).first()["recall_at_40"] == pytest.approx(best)


@pytest.mark.parametrize("strategy", ["f2", "f1", "f0.5", "precision@0.40", "precision@0.99"])
def test_threshold_matches_a_scan(spark, strategy):
    rows, df = scores(spark, 800, 4)
    known = [(p, y) for _, _, p, y in rows if y is not None]
    pos = sum(y for _, y in known)
    best, thr = -1.0, None
    for i in range(98):
        t = 0.01 + i * 0.01
        hit = [y for p, y in known if p >= t]
        if not hit:
            continue
        prec, rec = sum(hit) / len(hit), sum(hit) / pos
        if strategy.startswith("precision"):
            m = rec if prec >= float(strategy.split("@")[1]) else -1.0
        else:
            b2 = float(strategy[1:]) ** 2
            m = (1 + b2) * prec * rec / (b2 * prec + rec) if prec + rec else 0.0
        if m > best:
            best, thr = m, t
    got = sc.pick_threshold(df, strategy).first()
    want = thr if best >= 0 else (0.99 if strategy.startswith("precision") else 0.5)
    assert got["threshold"] == pytest.approx(want) and got["metric"] == pytest.approx(max(best, 0.0))


@pytest.mark.parametrize("args,steps", [((None, 10000.0, 8.0), 10), ((9900.0, 10000.0, 8.0), 3), ((0.0, 100000.0, 8.0), 10), ((7000.0, 10000.0, 10.0), 7)])
def test_useful_horizon(spark, args, steps):
    cols = [F.lit(a).cast("double") for a in args]
    assert spark.range(1).select(sc.useful_horizon(*cols, 60, 10)).first()[0] == steps


def test_isotonic_is_monotone_and_clipped(spark):
    _, df = scores(spark)
    bp = learn.fit_isotonic(df, 2)
    cal = [r["p_cal"] for r in learn.apply_isotonic(df, bp).orderBy("p").collect()]
    assert all(a <= b + 1e-9 for a, b in zip(cal, cal[1:])) and 0.0 <= min(cal) and max(cal) <= 1.0
    identity = df.withColumn("h", F.lit(2))
    assert learn.apply_isotonic(identity, bp).filter("abs(p - p_cal) > 1e-9").count() == 0


def test_bootstrap_weights_have_poisson_moments(spark):
    m = spark.range(40000).select(learn.bootstrap_weight("id", 3, 7).alias("w")).agg(F.avg("w"), F.variance("w")).first()
    assert m[0] == pytest.approx(1.0, abs=0.03) and m[1] == pytest.approx(1.0, abs=0.05)


def test_chunked_previous_equals_plain_lag(spark):
    rng = random.Random(2)
    # one key holds most rows and has chunks with a single row
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randint(0, 5)}", rng.choice([rng.randint(0, 500), 4000, 9000 + rng.randint(0, 30)]), i) for i in range(2000)]
    df = frame(spark, rows, "key string, t int, id int")
    got = {r["id"]: r["prev"] for r in previous_in_chunks(df, ["key"], ["t", "id"], F.floor(F.col("t") / 60), {"prev": F.col("id")}).collect()}
    want, last = {}, {}
    for key, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[i] = last.get(key)
        last[key] = i
    assert got == want


def test_cumulative_by_value(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice([0.5, rng.random()])) for _ in range(3000)]
    df = frame(spark, rows, "g string, v double")
    got = {(r["g"], r["v"]): r["cum_n"] for r in cumulative_by_value(df, ["g"], "v", {"n": F.lit(1).cast("bigint")}, descending=True).collect()}
    for g in "ab":
        vals = [v for k, v in rows if k == g]
        for v in set(vals):
            assert got[(g, v)] == sum(1 for x in vals if x >= v)


def test_score_log_query_keeps_the_clock_of_its_statement_in_summer_time(spark, tmp_path):
    """Event 5,990,000 is past 10 March 2024, 07:00 UTC; the statement's clock stays five hours behind UTC."""
    from checks import QUERIES

    ids = [4, 5_986_799, 5_986_801, 5_990_001]
    frame(spark, [(i, "view") for i in ids], "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {int(r["bus_id"][1:]): r["t_ref_min"] for r in QUERIES["s16_score_log_record"](spark, str(tmp_path)).collect()}
    assert got == {i: pytest.approx(((1_704_067_200 + i - 18_000) % 86_400) / 60, abs=1e-3) for i in ids}
