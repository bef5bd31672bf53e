"""Speed, resampling, teleport fold, projection and table replacement."""

import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import shapes
from tramline.operators import trajectory as tr
from tramline.session import shared_dir
from tramline.sources import store

BASE = 1_700_000_000


def track(spark, rows, trip="T"):
    df = spark.createDataFrame([(trip, "20231114", BASE + t, float(d), v) for t, d, v in rows], "trip_id string, start_date string, s long, travel_distance_m double, vehicle_id string")
    return df.select("trip_id", "start_date", F.timestamp_seconds("s").alias("datetime"), "travel_distance_m", "vehicle_id")


def secs(df, *cols):
    return [tuple(r) for r in df.select((F.unix_seconds("datetime") - BASE).alias("t"), *cols).orderBy("t").collect()]


def test_speed_on_arriving_row(spark):
    got = secs(tr.moving_speed(track(spark, [(0, 0, "V"), (10, 100, "V"), (30, 300, "V")])), "moving_speed_m_s")
    assert got == [(0, 0.0), (10, 10.0), (30, 10.0)]


def test_upsample_grid_and_nearer_end(spark):
    up = tr.upsample_grid(tr.moving_speed(track(spark, [(0, 0, "CUR"), (30, 300, "NEXT")])), 10)
    assert secs(up, "travel_distance_m", "vehicle_id", "observed") == [(0, 0.0, "CUR", False), (10, 100.0, "CUR", False), (20, 200.0, "NEXT", False)]


def test_upsample_cap_is_strict(spark):
    sp = tr.moving_speed(track(spark, [(0, 0, "V"), (30, 300, "V")]))
    assert tr.upsample_grid(sp, 10, 30).count() == 3
    assert tr.upsample_grid(sp, 10, 29.9).count() == 0


def test_upsample_needs_two_rows(spark):
    assert tr.upsample_grid(tr.moving_speed(track(spark, [(0, 0, "V")])), 10).count() == 0


def loop_upsample(rows, res):
    out = []
    for (ta, da), (tb, db) in zip(rows, rows[1:]):
        v = (db - da) / (tb - ta)
        g = -(-(BASE + ta) // res) * res
        while g < BASE + tb:
            out.append((g - BASE, da + (g - BASE - ta) * v))
            g += res
    return out


def test_upsample_matches_a_plain_loop(spark):
    rng = random.Random(5)
    t, d, rows = 0, 0.0, []
    for _ in range(200):
        rows.append((t, d))
        t += rng.randint(1, 200)
        d += rng.uniform(-40, 400)
    got = secs(tr.upsample_grid(tr.moving_speed(track(spark, [(a, b, "V") for a, b in rows])), 10), "travel_distance_m")
    want = loop_upsample(rows, 10)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-6)


def test_teleport_block_does_not_reanchor(spark):
    rows = [(0, 0), (10, 100), (20, 5000), (30, 5100), (40, 400), (50, 500)]
    df = track(spark, [(t, d, "V") for t, d in rows])
    assert [r[0] for r in secs(tr.teleport_filter(df))] == [0, 10, 40, 50]
    assert tr.teleport_filter(df, 0).count() == 6
    assert [r[0] for r in secs(tr.teleport_filter(df, None))] == [0, 10, 40, 50]


def test_teleport_matches_a_plain_fold(spark):
    rng = random.Random(9)
    frames, want = None, set()
    for n in range(12):
        rows, t = [], 0
        for _ in range(300):
            t += rng.randint(1, 30)
            rows.append((t, rng.choice([t * 8.0, t * 8.0 + rng.uniform(-900, 900)])))
        anchor = rows[0]
        want.add((f"T{n}", rows[0][0]))
        for t1, d1 in rows[1:]:
            if abs(d1 - anchor[1]) <= 35.0 * (t1 - anchor[0]):
                anchor = (t1, d1)
                want.add((f"T{n}", t1))
        df = track(spark, [(a, b, "V") for a, b in rows], f"T{n}")
        frames = df if frames is None else frames.unionByName(df)
    got = {(r[0], r[1]) for r in tr.teleport_filter(frames).select("trip_id", F.unix_seconds("datetime") - BASE).collect()}
    assert got == want


def line(spark, xy, shape="S"):
    """Segments straight from metres, bypassing the projection."""
    rows, cum = [], 0.0
    for i, ((x0, y0), (x1, y1)) in enumerate(zip(xy, xy[1:])):
        n = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
        rows.append((shape, i, float(x0), float(y0), float(x1), float(y1), cum, n))
        cum += n
    return spark.createDataFrame(rows, "shape_id string, seg_no int, x0 double, y0 double, x1 double, y1 double, cum_m double, len_m double")


def at_xy(spark, pts, monkeypatch):
    monkeypatch.setattr(shapes, "with_xy", lambda df, *a, **k: df)
    return spark.createDataFrame([("S", i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "shape_id string, id int, x double, y double").withColumn("keep", F.lit(1))


def test_projection_on_an_l(spark, monkeypatch):
    pts = at_xy(spark, [(25, 0), (100, 50), (25, 500)], monkeypatch)
    got = {r["id"]: r["travel_distance_m"] for r in shapes.nearest_on_shape(pts, line(spark, [(0, 0), (100, 0), (100, 100)])).collect()}
    assert got == {0: pytest.approx(25), 1: pytest.approx(150)}


def test_cell_join_equals_full_scan(spark, monkeypatch):
    rng = random.Random(3)
    xy = [(0, 0)]
    for _ in range(25):
        xy.append((xy[-1][0] + rng.uniform(-900, 1500), xy[-1][1] + rng.uniform(-900, 1500)))
    pts = at_xy(spark, [(rng.uniform(-500, 9000), rng.uniform(-500, 9000)) for _ in range(3000)], monkeypatch)
    segs = line(spark, xy)
    near = {r["id"]: r["orthogonal_distance_m"] for r in shapes.nearest_on_shape(pts, segs).collect()}
    full = {r["id"]: r["orthogonal_distance_m"] for r in shapes.nearest_on_shape_unpruned(pts, segs).collect()}
    assert near == {k: v for k, v in full.items() if v <= 200.0} and len(near) > 50


def stops_at(spark, xs):
    return spark.createDataFrame([("S", xs)], "shape_id string, stops array<struct<x: double, y: double>>")


def test_monotone_stops(spark):
    out_and_back = line(spark, [(0, 0), (1000, 0), (0, 0)])
    got = shapes.monotone_stop_distances(stops_at(spark, [(200.0, 0.0), (900.0, 0.0), (400.0, 0.0)]), out_and_back).first()["distances"]
    assert got == pytest.approx([200, 900, 1600])
    straight = line(spark, [(0, 0), (1000, 0)])
    got = shapes.monotone_stop_distances(stops_at(spark, [(500.0, 0.0), (499.5, 0.0), (5000.0, 0.0), (10.0, 0.0)]), straight).first()["distances"]
    assert got == pytest.approx([500, 500, 1000, 1000])


def test_replace_is_idempotent_and_clears_emptied_instances(spark):
    path = shared_dir(spark, "replace")
    make = lambda rows: spark.createDataFrame(rows, "trip_id string, start_date string, travel_distance_m double, service_date string").withColumn("service_date", F.to_date("service_date"))
    store.write_trajectories_replace(make([("A", "20240101", 1.0, "2024-01-01"), ("B", "20240101", 2.0, "2024-01-01"), ("C", "20240102", 3.0, "2024-01-02")]), path)
    new = make([("A", "20240101", 9.0, "2024-01-01")])
    keys = spark.createDataFrame([("A", "20240101"), ("C", "20240102")], "trip_id string, start_date string")
    for _ in range(2):
        store.write_trajectories_replace(new, path, keys)
        got = sorted((r["trip_id"], r["travel_distance_m"]) for r in store.read_trajectories(spark, path).collect())
        assert got == [("A", 9.0), ("B", 2.0)]


def test_echo_of_an_old_instance_is_not_part_of_it(spark):
    rows = [("T", "20260115", "2026-01-15 12:00:00"), ("T", "20260115", "2026-01-14 22:59:59"), ("T", "20260115", "2026-01-14 23:00:00"),
            ("T", "20260115", "2026-01-16 10:59:59"), ("T", "20260115", "2026-01-16 11:00:00"), ("T", "bad", "2026-03-01 00:00:00")]
    df = spark.createDataFrame(rows, "trip_id string, start_date string, f string").withColumn("fetched_at", F.to_timestamp("f"))
    got = sorted(r["f"] for r in tr.within_fetch_slack(df).collect())
    assert got == ["2026-01-14 23:00:00", "2026-01-15 12:00:00", "2026-01-16 10:59:59", "2026-03-01 00:00:00"]
