"""Order statistics, monotone calibration, stacking and split gain against plain versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.operators import learn, order_stats


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


# --- order statistics --------------------------------------------------------------------


def test_quantiles_equal_sorting(spark):
    rng = random.Random(1)
    draws = {
        "normal": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.randint(-2, 2)), "spread": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300),
        "one": lambda: 7.25, "close": lambda: 1.0 + rng.randint(0, 5) * 2.0**-52, "zeros": lambda: rng.choice([0.0, -0.0]), None: lambda: rng.random()}
    rows = [(g, draw()) for g, draw in draws.items() for _ in range(rng.randint(150, 400))] + [("normal", None), ("single", 3.5), ("none", None)]
    qs = {"p0": 0.0, "p01": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["g"]: r for r in order_stats.exact_quantiles(frame(spark, rows, "g string, v double"), ["g"], "v", qs).collect()}
    assert set(got) == {*draws, "single"}
    for g in got:
        values = sorted(v for k, v in rows if k == g and v is not None)
        for name, q in qs.items():
            at = (len(values) - 1) * q
            low, high = values[math.floor(at)], values[math.ceil(at)]
            assert got[g][name] == pytest.approx(low if low == high else low + (high - low) * (at - math.floor(at)), rel=1e-12, abs=0), (g, name)


def test_quantiles_without_keys_and_of_nothing(spark):
    df = frame(spark, [(float(x),) for x in range(101)], "v double")
    assert order_stats.exact_quantiles(df, (), "v", {"a": 0.25, "b": 0.995}).first().asDict() == {"a": 25.0, "b": 99.5}
    assert order_stats.exact_quantiles(df.filter("v < 0"), (), "v", {"a": 0.5}).first()["a"] is None


def test_one_value_takes_no_round_and_seven_rounds_are_enough(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(order_stats, "materialise", lambda df, name, keep=order_stats.materialise: (seen.append(name), keep(df, name))[1])
    order_stats.exact_quantiles(frame(spark, [(5.0,)] * 50, "v double"), (), "v", {"a": 0.5}).collect()
    assert seen.count("ranks") == 1
    seen.clear()
    values = [math.ldexp(s * (1 + m * 2.0**-52), e) for s in (-1, 1) for m in range(4) for e in range(-1000, 1000, 3)]
    order_stats.exact_quantiles(frame(spark, [(v,) for v in values], "v double"), (), "v", {"a": 0.3}).collect()
    assert seen.count("ranks") <= 8


# --- monotone calibration ----------------------------------------------------------------


def max_min(points):
    """Sorted (x, sum, weight) to fitted means by the max-min formula."""
    means = lambda a, b: sum(p[1] for p in points[a: b + 1]) / sum(p[2] for p in points[a: b + 1])
    n = len(points)
    return [max(min(means(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


@pytest.mark.parametrize("range_rows", [250_000, 7])
def test_isotonic_equals_the_max_min_form(spark, monkeypatch, range_rows):
    monkeypatch.setattr(learn, "RANGE_ROWS", range_rows)
    rng = random.Random(2)
    rows = []
    for h, shape in ((1, lambda x: x), (2, lambda x: 1 - x), (3, lambda x: 0.5 + 0.4 * math.sin(9 * x)), (4, lambda x: x > 0.6)):
        for k in range(120):
            x = round(rng.random(), 2)
            rows.append((f"e{k}", h, x, float(rng.random() < shape(x))))
    rows += [("n", 1, 0.5, None), ("n", 5, 0.3, 1.0), ("n", 5, 0.4, 1.0)]
    df = frame(spark, rows, "example_id string, h int, p double, y double")
    bp = learn.fit_isotonic(df, 6)
    cal = {(r["example_id"], r["h"], r["p"], r["y"]): r["p_cal"] for r in learn.apply_isotonic(df, bp).collect()}
    for h in (1, 2, 3, 4):
        known = sorted({x for _, g, x, y in rows if g == h and y is not None})
        points = [(x, sum(y for _, g, p, y in rows if g == h and p == x and y is not None), sum(1 for _, g, p, y in rows if g == h and p == x and y is not None)) for x in known]
        want = dict(zip(known, max_min(points)))
        for (e, g, p, y), got in cal.items():
            if g == h and y is not None:
                assert got == pytest.approx(want[p], abs=1e-12)
    assert cal["n", 5, 0.3, 1.0] == pytest.approx(0.3)  # one class: the identity
    assert {r["h"] for r in bp.collect()} == {1, 2, 3, 4, 5, 6}


def test_isotonic_by_model_is_the_fit_of_each(spark):
    rng = random.Random(3)
    rows = [(m, f"e{k}", h, rng.random(), float(rng.random() < 0.4)) for m in "ab" for h in (1, 2) for k in range(80)]
    df = frame(spark, rows, "model string, example_id string, h int, p double, y double")
    both = {tuple(r) for r in learn.fit_isotonic(df, 2, by=["model"]).collect()}
    each = {(m, *r) for m in "ab" for r in learn.fit_isotonic(df.filter(F.col("model") == m), 2).collect()}
    assert both == each


# --- stacking ----------------------------------------------------------------------------


def newton(x, y, ridge):
    z, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    pull = np.array([0.0] + [ridge] * x.shape[1])
    for _ in range(100):
        m = 1 / (1 + np.exp(-z @ beta))
        beta = beta - np.linalg.solve((z * (m * (1 - m))[:, None]).T @ z + np.diag(pull), z.T @ (m - y) + pull * beta)
    return beta


def test_stack_of_all_horizons_equals_a_fit_of_each(spark):
    rng = np.random.default_rng(4)
    rows = []
    for h in (1, 2, 3):
        for k in range(200):
            y = float(rng.random() < 0.3) if h < 3 else 0.0
            for m in "abc":
                rows.append((m, k, h, float(np.clip(0.2 + 0.4 * y + rng.normal(0, 0.2), 0, 1)), y))
    df = frame(spark, rows, "model string, example_id int, h int, p double, y double")
    val, test = df.filter("example_id % 2 = 0"), df.filter("example_id % 2 = 1")
    got = {(r["example_id"], r["h"]): r["p"] for r in learn.ensemble_stack(val, test, ["a", "b", "c"], 3).collect()}
    assert len(got) == 300
    at = {(m, k, h): p for m, k, h, p, _ in rows}
    for h in (1, 2):
        x = np.array([[at[m, k, h] for m in "abc"] for k in range(0, 200, 2)])
        y = np.array([next(r[4] for r in rows if r[1] == k and r[2] == h) for k in range(0, 200, 2)])
        beta = newton(x, y, 1.0)
        for k in range(1, 200, 2):
            assert got[k, h] == pytest.approx(1 / (1 + np.exp(-(beta[0] + beta[1:] @ [at[m, k, h] for m in "abc"]))), abs=1e-6)
    assert got[1, 3] == pytest.approx(np.mean([at[m, 1, 3] for m in "abc"]))


def test_stack_survives_separable_rows_and_missing_models(spark):
    rows = [(m, k, 1, (0.9 if k < 10 else 0.1), float(k < 10)) for m in "ab" for k in range(20)] + [("a", 99, 1, 0.5, 1.0)]
    df = frame(spark, rows, "model string, example_id int, h int, p double, y double")
    got = {r["example_id"]: r["p"] for r in learn.ensemble_stack(df, df, ["a", "b"], 1).collect()}
    assert got[99] is None and got[0] > 0.5 > got[19]


# --- split gain --------------------------------------------------------------------------


def walk(node, sums):
    if node.getClass().getSimpleName() == "InternalNode":
        f = node.split().featureIndex()
        sums[f] = sums.get(f, 0.0) + node.gain() * node.impurityStats().count()
        walk(node.leftChild(), sums)
        walk(node.rightChild(), sums)


def test_gain_equals_a_plain_walk(spark):
    rng = random.Random(5)
    rows = [(f"e{k}", [rng.random() for _ in range(6)]) for k in range(200)]
    rows = [(e, x, [float(x[0] + x[3] > 1), float(x[5] > 0.5), 1.0]) for e, x in rows]
    df = frame(spark, rows, "example_id string, features array<double>, labels array<double>").cache()
    bags = learn.train_bag(df, None, 3, bags=2, trees=3, depth=3, min_leaf=2)
    want = {}
    for bag in bags:
        for model in bag.models:
            for tree in model._java_obj.trees() if model is not None else ():
                walk(tree.rootNode(), want)
    got = {(r["channel"], r["tick"]): r for r in learn.gain_importance(spark, bags, ["u", "v", "w"], 2).collect()}
    assert len(got) == 6 and sum(r["gain_pct"] for r in got.values()) == pytest.approx(100.0)
    for f in range(6):
        assert got["uvw"[f % 3], f // 3]["gain"] == pytest.approx(want.get(f, 0.0))
    nodes = learn.node_tables(spark, bags).groupBy("bag", "h").count().collect()
    assert {(r["bag"], r["h"]) for r in nodes} == {(0, 1), (0, 2), (1, 1), (1, 2)}  # horizon 3 is a constant
    constant = learn.gain_importance(spark, [learn.HorizonModels([None], [0.5])], ["u"], 1).first()
    assert constant["gain"] == 0.0 and constant["gain_pct"] == 0.0


# --- another grid ------------------------------------------------------------------------


def test_a_model_of_another_grid_is_read_at_the_same_lead_time(spark):
    from tramline.plans import forecasting

    scaler = spark.createDataFrame([(0.0, 1.0, 0.0, 1.0)], "speed_mean double, speed_std double, gap_mean double, gap_std double")
    same = spark.createDataFrame([(h, x, x) for h in (1, 2, 3) for x in (0.0, 1.0)], "h int, x double, y double")
    model = forecasting.Forecaster(scaler, [learn.HorizonModels([None] * 3, [0.1, 0.2, 0.3])], same, None, 3, 4, 20)
    tick = [1.0, 100.0, 2.0, 200.0, 3.0, 300.0]
    rows = [("short", [tick] * 2, [[0.5]] * 2), ("long", [tick] * 6, [[0.5]] * 6)]
    df = spark.createDataFrame(rows, "example_id string, window array<array<double>>, extras array<array<double>>")
    got = {r["example_id"]: r for r in forecasting.score_on_grid(df, model, 30, 4).collect()}
    for r in got.values():
        assert r["probs"] == pytest.approx([0.1, 0.3, 0.3, 0.3])  # 30 s is the model's +20 s, 60 s its +60 s
        assert len(r["features"]) == 4 * 7


def test_a_fit_computes_its_rows_once_and_fits_at_once_change_nothing(spark):
    rng = np.random.default_rng(5)
    rows = [(f"e{k}", [float(v) for v in rng.random(4)]) for k in range(300)]
    rows = [(e, x, [float(x[0] > 0.6), 0.0]) for e, x in rows]
    df = frame(spark, rows, "example_id string, features array<double>, labels array<double>").coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    params = dict(trees=2, depth=2, min_leaf=2)
    learn.train_horizons(df.mapInPandas(counted, df.schema), None, 2, **params)
    assert seen.value <= 300 * 2  # the label counts and the fit
    stored = learn.stored_rows(df, "rows")
    assert stored.columns == ["example_id", "fv", "labels"]
    # labels are summed in the order of the rows' tasks: the last bits are left open
    text = lambda m: re.sub(r"-?\d+\.\d+(E-?\d+)?", lambda x: f"{float(x[0]):.9f}", m.toDebugString.split("\n", 1)[1])
    trees = lambda bags: [[m and text(m) for m in b.models] + b.constants for b in bags]
    one = learn.train_bag(df, None, 2, bags=2, parallel=1, **params)
    many = learn.train_bag(stored, None, 2, bags=2, parallel=4, **params)
    assert trees(one) == trees(many) and one[0].constants == [None, 0.0]
    probs = lambda rows, bags: {r["example_id"]: r["probs"] for r in learn.predict_bag(rows, bags).collect()}
    a, b = probs(df, one), probs(stored, many)
    assert a.keys() == b.keys() and all(a[e] == pytest.approx(b[e]) for e in a)
    assert set(learn.predict_bag(df, one).columns) == {*df.columns, "probs"}
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
