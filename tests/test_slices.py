"""Segmentation and detector scenarios on hand-made runs."""

import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import buses, detect, rollups

BASE = 1_717_250_400  # 2024-06-01 10:00 local, minute 600
STOPS = 31


def rows(spark, data):
    """data: (trip, vehicle, t, d, v)"""
    df = spark.createDataFrame([(t, v, BASE + s, float(d), None if sp is None else float(sp)) for t, v, s, d, sp in data],
                               "trip_id string, vehicle_id string, s long, travel_distance_m double, moving_speed_m_s double")
    return df.select("trip_id", "vehicle_id", F.timestamp_seconds("s").alias("datetime"), "travel_distance_m", "moving_speed_m_s",
                     F.lit("20240601").alias("start_date"), F.to_date(F.lit("2024-06-01")).alias("service_date"), F.lit("R").alias("route_id"),
                     F.lit(0).alias("direction_id"), F.lit(None).cast("string").alias("occupancy_status"))


def stops(spark, gap=500.0):
    return spark.range(STOPS).select(F.lit("R").alias("route_id"), F.lit(0).alias("direction_id"), F.col("id").cast("int").alias("stop_idx"), (F.col("id") * gap).alias("distance_m"))


def group(spark, data):
    return buses.group_into_buses(rows(spark, data), stops(spark))


def segments(points):
    return sorted((r["trip_id"], r["vehicle_id"], r["segment"], r["n"]) for r in points.groupBy("trip_id", "vehicle_id", "segment").agg(F.count("*").alias("n")).collect())


def moving(trip, vehicle, t0, t1, d0=0.0, v=8.0, step=60):
    return [(trip, vehicle, t, d0 + (t - t0) * v, v) for t in range(t0, t1 + 1, step)]


def still(trip, vehicle, t0, t1, d, step=60):
    return [(trip, vehicle, t, d, 0.0) for t in range(t0, t1 + 1, step)]


def test_two_vehicles_are_two_buses(spark):
    got = segments(group(spark, moving("T", "A", 0, 600) + moving("T", "B", 30, 630)))
    assert [g[:3] for g in got] == [("T", "A", 0), ("T", "B", 0)]


def test_stale_tail_is_trimmed(spark):
    got = segments(group(spark, moving("T", "A", 0, 600) + still("T", "A", 660, 660 + 1800, 4800)))
    assert got == [("T", "A", 0, 11)]


def test_long_layover_splits_and_short_dwell_does_not(spark):
    run = moving("T", "A", 0, 600) + still("T", "A", 660, 660 + 1500, 4800) + moving("T", "A", 2220, 2820, 4900)
    assert [g[2] for g in segments(group(spark, run))] == [0, 1]
    run = moving("T", "A", 0, 600) + still("T", "A", 660, 900, 4800) + moving("T", "A", 960, 1560, 4900)
    assert [g[2] for g in segments(group(spark, run))] == [0]


def test_all_stale_gives_nothing_and_a_single_point_stays(spark):
    assert segments(group(spark, still("T", "A", 0, 3000, 10))) == []
    assert segments(group(spark, [("T", "A", 0, 10.0, 0.0)])) == [("T", "A", 0, 1)]


def test_null_vehicle_is_numbered_last(spark):
    pts = group(spark, moving("T", None, 0, 600) + moving("T", "Z", 0, 600))
    got = {r["vehicle_id"]: r["bus_index"] for r in buses.number_buses(pts, pts).select("vehicle_id", "bus_index").distinct().collect()}
    assert got == {"Z": 0, None: 1}


def pair(gap, seconds=600, v=8.0):
    lead = [("L", "L", t, 1000 + t * v, v) for t in range(0, seconds + 1, 10)]
    follow = [("F", "F", t, 1000 + t * v - gap(t), v) for t in range(0, seconds + 1, 10)]
    return lead + follow


def distance_events(spark, data, *limits):
    pts = group(spark, data)
    return detect.bunch_distance_events(detect.interpolate_on_ticks(pts), *limits).collect()


def test_close_pair_is_one_event_on_the_follower(spark):
    got = distance_events(spark, pair(lambda t: 80))
    assert len(got) == 1 and got[0]["bus_id"].startswith("F")
    assert got[0]["minute_of_day"] == pytest.approx(605) and got[0]["stop_index"] == pytest.approx((920 + 920 + 4800) / 2 / 500)


def test_far_pair_and_single_bus_give_none(spark):
    assert distance_events(spark, pair(lambda t: 500)) == []
    assert distance_events(spark, moving("T", "A", 0, 600, step=10)) == []


def test_three_buses_tag_both_followers(spark):
    data = pair(lambda t: 80) + [("G", "G", t, 1000 + t * 8.0 - 160, 8.0) for t in range(0, 601, 10)]
    assert sorted(e["bus_id"][0] for e in distance_events(spark, data)) == ["F", "G"]


def test_hysteresis_joins_an_oscillating_gap(spark):
    import math

    data = pair(lambda t: 160 + 30 * math.sin(2 * math.pi * t / 120))
    assert len(distance_events(spark, data)) > 1
    assert len(distance_events(spark, data, 150.0, 200.0)) == 1


def test_short_brush_is_dropped(spark):
    data = pair(lambda t: 80 if t <= 30 else 400)
    assert len(distance_events(spark, data)) == 1 and distance_events(spark, data, 150.0, None, 60.0) == []


def test_runs_match_a_state_machine(spark):
    rng = random.Random(11)
    gaps = [rng.choice([60, 120, 170, 260]) for _ in range(200)]
    pts = pair(lambda t: gaps[t // 30] if t // 30 < len(gaps) else 500, 30 * 199)
    ticks = detect.interpolate_on_ticks(group(spark, [p for p in pts if p[2] % 30 == 0]))
    got = sorted((r["t0_us"] // 1_000_000 - BASE, r["t1_us"] // 1_000_000 - BASE) for r in detect.bunch_distance_runs(ticks, 100.0, 200.0, 0.0).collect())
    want, open_run = [], None
    for i, g in enumerate(gaps):
        if g < (200 if open_run else 100):
            open_run = (open_run[0] if open_run else i * 30, i * 30)
        elif open_run:
            want.append(open_run)
            open_run = None
    want += [open_run] if open_run else []
    assert got == want


def test_idle_uses_signed_speed_and_minimum_time(spark):
    data = moving("T", "A", 0, 600, step=10) + [("T", "A", 610 + 10 * i, 4800 - i, -0.1) for i in range(31)] + moving("T", "A", 930, 1500, 4800, step=10)
    got = detect.idle_events(group(spark, data)).collect()
    assert len(got) == 1
    assert detect.idle_events(group(spark, data), 6.0).count() == 0


def test_backward_travel_crosses_stops(spark):
    data = [("T", "A", 0, 2000.0, 5.0), ("T", "A", 100, 900.0, -11.0), ("T", "A", 200, 3000.0, 21.0)]
    got = {r["stop"]: (r["cross_us"] - BASE * 1_000_000) / 1e6 for r in detect.stop_crossings(group(spark, data)).collect()}
    assert got[3] == pytest.approx(100 * 500 / 1100, abs=1e-5) and got[4] == 0.0 and got[6] == pytest.approx(200.0)


def test_allocation_shares_sum_to_hundred(spark):
    pts = group(spark, pair(lambda t: 80) + still("I", "I", 0, 600, 3000, 10) + moving("I", "I", 610, 1200, 3000, step=10))
    out = rollups.hourly_time_allocation(pts, detect.detect_all(pts, method="both")).filter("hour = 10").first()
    assert out["idle_pct"] > 0 and out["bunch_pct"] > 0
    assert out["normal_pct"] + out["idle_pct"] + out["bunch_pct"] + out["crowd_pct"] == pytest.approx(100, abs=0.2)
