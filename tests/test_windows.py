"""Windows and context layouts against a plain walk over each window."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tramline.defaults import NO_LEADER_GAP_M
from tramline.operators import examples as ex

STEP, LENGTH = 60, 8


def chain_rows():
    rng, rows = random.Random(1), []
    for bus in ("b1", "b2"):
        dist = 0.0
        for k in range(1000, 1060):
            dist += rng.uniform(0, 500)
            if rng.random() < 0.04:
                continue  # a hole
            rows.append(("d", "R", 0, bus, "t", k, dist, rng.choice([None, 0.0, 0.3, rng.uniform(0.5, 12)]), rng.uniform(0, 31), 31,
                         rng.choice([NO_LEADER_GAP_M, rng.uniform(10, 3000)]), rng.choice([0.0, rng.uniform(1, 9)]), rng.uniform(0, 900), 2.0, 30.0, 40_000.0 if bus == "b1" else None))
    return rows


SCHEMA = ("service_date string, route_id string, direction_id int, bus_id string, trip_id string, k long, dist_m double, speed double, stop_index double, num_stops int, "
          "fwd_gap_m double, d1_speed double, d1_gap_m double, d2_speed double, d2_gap_m double, shape_length_m double")


def plain(window, layout):
    """Context of each tick of a window, by the rules."""
    out = []
    for i, x in enumerate(window):
        lb = min(3, i)
        closing = 0.0
        if lb and window[i - lb]["fwd_gap_m"] < NO_LEADER_GAP_M and x["fwd_gap_m"] < NO_LEADER_GAP_M:
            closing = (window[i - lb]["fwd_gap_m"] - x["fwd_gap_m"]) / (lb * STEP)
        recent = [y["speed"] for y in window[max(0, i - 4): i + 1] if y["speed"] is not None]
        moving = [v for v in recent if v >= 0.5]
        median = statistics.median(moving or recent) if recent else 0.0
        line = x["shape_length_m"] or 0.0
        left = max(0.0, line - x["dist_m"])
        v = lambda y: y["speed"] or 0.0
        m = ((x["k"] * STEP - 18_000) % 86_400) / 60
        values = {
            "stop_index": x["stop_index"], "stop_index_norm": x["stop_index"] / x["num_stops"], "gap_closure_m_per_s": closing, "leader_speed": x["d1_speed"],
            "dwell_recent_s": 60.0 * sum(s < 0.5 for s in recent), "tod_sin": math.sin(2 * math.pi * m / 1440), "tod_cos": math.cos(2 * math.pi * m / 1440),
            "dist_to_terminus_m": left if line else 0.0, "dist_to_terminus_norm": left / line if line else 0.0,
            "time_to_terminus_min": left / max(median, 1.0) / 60 if line else 0.0,
            "rel_speed_to_d1": v(x) - x["d1_speed"] if x["d1_speed"] else 0.0, "target_accel_3tick": (v(x) - v(window[i - 3])) / (3 * STEP) if i >= 3 else 0.0,
        }
        out.append([values[n] for n in ex.CONTEXT[layout]])
    return out


@pytest.mark.parametrize("layout", [1, 2, 3, 4])
def test_context_equals_a_walk_of_each_window(spark, layout):
    df = spark.createDataFrame(chain_rows(), SCHEMA).repartition(3)
    rows = ex.history_window(df, LENGTH, STEP, edge=2, layout=layout).select("bus_id", "k", ex.context_features(layout, LENGTH, STEP).alias("x"),
                                                                             ex.window_channels(F.col("hist")).alias("w")).collect()
    by = {(r["bus_id"], r["k"]): r for r in df.collect()}
    want = {}
    for (bus, k), x in by.items():
        window = [by.get((bus, j)) for j in range(k - LENGTH + 1, k + 1)]
        if None in window or not 2 <= x["stop_index"] < 29 or all(y["fwd_gap_m"] >= NO_LEADER_GAP_M for y in window):
            continue
        want[bus, k] = window
    assert {(r["bus_id"], r["k"]) for r in rows} == set(want) and len(rows) == len(want) > 20
    for r in rows:
        window = want[r["bus_id"], r["k"]]
        for got, expected in zip(r["x"], plain(window, layout), strict=True):
            assert got == pytest.approx(expected, abs=1e-9)
        assert [w[0] for w in r["w"]] == [y["speed"] or 0.0 for y in window] and [w[1] for w in r["w"]] == [y["fwd_gap_m"] for y in window]


def test_a_tick_at_a_sample_takes_its_value(spark):
    """-0.08 + 1 * (0.5 + 0.08) is below 0.5 in doubles, and would count as dwell."""
    rows = [("d", "R", 0, "b1", "t", "20240101", "v", t, x, v, x / 500) for t, x, v in ((50, 0.0, -0.08), (60, 88.4, 0.5), (130, 123.4, 0.7))]
    df = spark.createDataFrame(rows, "service_date string, route_id string, direction_id int, bus_id string, trip_id string, start_date string, vehicle_id string, t long, "
                                     "travel_distance_m double, moving_speed_m_s double, stop_index double").withColumn("datetime", F.timestamp_seconds("t"))
    got = {r["k"]: r for r in ex.grid_track(df, 60).collect()}
    assert got[1]["speed"] == 0.5 and got[1]["dist_m"] == 88.4
    assert got[2]["speed"] == pytest.approx(0.5 + 60 / 70 * 0.2)
