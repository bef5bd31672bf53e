"""Per-horizon classifiers, bags, calibration and stacking on ``pyspark.ml``.

Inputs are examples with ``features`` (array), ``labels`` (array over horizons) and
``example_id``. A horizon whose training labels hold one class becomes a constant.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, shared_dir
from .lookup import interval_lookup
from .scoring import average_precision, pick_threshold, to_long

PARALLEL_FITS = 3  # fits at a time; each keeps its rows and their bins until it ends


@dataclass
class HorizonModels:
    """One model or constant per horizon (index 0 is +1)."""

    models: list[Any] = field(default_factory=list)
    constants: list[float | None] = field(default_factory=list)

    @property
    def horizon(self) -> int:
        return len(self.models)


def _vectors(examples: DataFrame) -> DataFrame:
    return examples if "fv" in examples.columns else examples.withColumn("fv", array_to_vector("features"))


def stored_rows(examples: DataFrame, name: str) -> DataFrame:
    """What fits read, ``example_id, fv, labels``, stored: the array becomes a vector once, not in each pass of each fit."""
    return materialise(_vectors(examples).select("example_id", "fv", "labels"), name)


def class_counts(examples: DataFrame, horizon: int, weight: str | None = None) -> list[tuple[float, float]]:
    """Positives and negatives per horizon in one pass; a handful of numbers for the driver."""
    w = F.col(weight) if weight else F.lit(1.0)
    cols = []
    for h in range(horizon):
        y = F.col("labels")[h]
        cols += [F.sum(F.when(y == 1, w).otherwise(0.0)), F.sum(F.when(y == 0, w).otherwise(0.0))]
    row = examples.agg(*cols).first()
    return [(row[2 * h] or 0.0, row[2 * h + 1] or 0.0) for h in range(horizon)]


def train_horizons(train: DataFrame, val: DataFrame | None, horizon: int, weight: str | None = None,
                   trees: int = 300, depth: int = 6, rate: float = 0.05, min_leaf: int = 50, seed: int = 2026,
                   parallel: int = PARALLEL_FITS) -> HorizonModels:
    """A boosted classifier per horizon on the rows with a known label.

    Positives weigh (negatives / positives). With validation rows, boosting stops when they no
    longer improve. The training frame should be stored by the caller, best by ``stored_rows``: each horizon
    reads it again.
    """
    fits = _horizon_fits(train, val, horizon, weight, trees, depth, rate, min_leaf, seed)
    return _collect_fits(train.sparkSession, [fits], parallel)[0]


def _horizon_fits(train: DataFrame, val: DataFrame | None, horizon: int, weight: str | None, trees: int = 300, depth: int = 6,
                  rate: float = 0.05, min_leaf: int = 50, seed: int = 2026) -> list:
    """Per horizon a constant, or its classifier and the rows to fit it on."""
    out = []
    counts = class_counts(train, horizon, weight)
    rows = _vectors(train).withColumn("_val", F.lit(False))
    if val is not None:
        vrows = _vectors(val).withColumn("_val", F.lit(True))
        if weight and weight not in vrows.columns:
            vrows = vrows.withColumn(weight, F.lit(1.0))
        shared = [c for c in rows.columns if c in vrows.columns]
        rows = rows.select(*shared).unionByName(vrows.select(*shared))
    base = F.col(weight) if weight else F.lit(1.0)
    for h in range(horizon):
        pos, neg = counts[h]
        if pos == 0 or neg == 0:
            out.append(pos / max(1.0, pos + neg))
            continue
        y = F.col("labels")[h]
        fit_on = rows.filter(y.isNotNull()).select(
            "fv", "_val", y.alias("y"), (base * F.when(y == 1, neg / pos).otherwise(1.0)).alias("w"))
        gbt = GBTClassifier(featuresCol="fv", labelCol="y", weightCol="w", maxIter=trees, maxDepth=depth, stepSize=rate,
                            minInstancesPerNode=min_leaf, seed=seed)
        if val is not None:
            gbt = gbt.setValidationIndicatorCol("_val")
        out.append((gbt, fit_on.filter("w > 0")))
    return out


def _collect_fits(spark: SparkSession, groups: list[list], parallel: int) -> list[HorizonModels]:
    """Fits all groups' classifiers, ``parallel`` at a time, and gives a group's models each.

    A fit reads its rows several times before it has binned them and then runs many short jobs: its rows are persisted until
    it ends, and fits beside it fill the cores that a job's last tasks leave idle. Each model is the one a fit alone gives.
    """

    def fit(job):
        gbt, rows = job
        rows = rows.persist()
        try:
            return gbt.fit(rows)
        finally:
            rows.unpersist()

    jobs = [x for fits in groups for x in fits if isinstance(x, tuple)]
    with ThreadPool(max(1, min(parallel, len(jobs)))) as pool:
        models = iter(pool.map(inheritable_thread_target(spark)(fit), jobs, chunksize=1))
    out = []
    for fits in groups:
        known = [x if isinstance(x, float) else None for x in fits]
        out.append(HorizonModels([next(models) if c is None else None for c in known], known))
    return out


def predict_horizons(examples: DataFrame, fitted: HorizonModels) -> DataFrame:
    """Probability vector per example, one pass over the rows through all horizons' models."""
    rows = _vectors(examples)
    parts = []
    for h, (model, const) in enumerate(zip(fitted.models, fitted.constants)):
        name = f"_p{h}"
        if model is None:
            rows = rows.withColumn(name, F.lit(float(const)))
        else:
            m = model.copy().setFeaturesCol("fv").setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"_pv{h}")
            rows = m.transform(rows).withColumn(name, vector_to_array(f"_pv{h}")[1]).drop(f"_pv{h}")
        parts.append(name)
    own = [] if "fv" in examples.columns else ["fv"]
    return rows.withColumn("probs", F.array(*parts)).drop(*own, *parts)


def bootstrap_weight(example_id: str, bag: int, seed: int) -> F.Column:
    """Poisson(1) copies of a row for one bag: the streaming form of drawing rows with
    replacement. Depends only on the id, so it is the same on every retry."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(bag), F.col(example_id)), F.lit(1 << 52)) / float(1 << 52)
    cum, term, k = 0.0, 0.36787944117144233, 0  # exp(-1)
    steps = []
    while term > 2.0**-53:  # the draws' own resolution
        cum += term
        steps.append((cum, float(k)))
        k += 1
        term /= k
    out = F.lit(float(k))
    for limit, k in reversed(steps):
        out = F.when(u < limit, k).otherwise(out)
    return out


def train_bag(train: DataFrame, val: DataFrame | None, horizon: int, bags: int = 8, seed: int = 2026,
              parallel: int = PARALLEL_FITS, **params) -> list[HorizonModels]:
    """``train_horizons`` on each bag's draw; the fits of all bags share one queue."""
    fits = []
    for b in range(bags):
        drawn = train.withColumn("bag_w", bootstrap_weight("example_id", b, seed)).filter("bag_w > 0")
        fits.append(_horizon_fits(drawn, val, horizon, "bag_w", seed=seed + b, **params))
    return _collect_fits(train.sparkSession, fits, parallel)


def predict_bag(examples: DataFrame, bags: Sequence[HorizonModels]) -> DataFrame:
    """Mean of the bags' vectors."""
    rows = _vectors(examples)  # once for all bags
    for b, fitted in enumerate(bags):
        rows = predict_horizons(rows, fitted).withColumnRenamed("probs", f"_b{b}")
    horizon = bags[0].horizon
    mean = F.array(*[sum((F.col(f"_b{b}")[h] for b in range(len(bags))), F.lit(0.0)) / len(bags) for h in range(horizon)])
    own = [] if "fv" in examples.columns else ["fv"]
    return rows.withColumn("probs", mean).drop(*own, *[f"_b{b}" for b in range(len(bags))])


# --- calibration --------------------------------------------------------------------------


RANGE_ROWS = 250_000  # distinct scores that one value range holds, about


def _pool_violators(keys: Sequence[str], schema: str):
    """Streams rows sorted by keys and value; blocks whose mean does not rise above the one before are pooled with it.

    Sums and weights are whole numbers, compared crosswise, so pooling is exact.
    """
    names = [*keys, "lo", "hi", "s", "w"]

    def pool(batches):
        key, stack = None, []

        def blocks():
            return pd.DataFrame([(*key, *b) for b in stack], columns=names)

        for rows in batches:
            for row in zip(*[rows[c].tolist() for c in names], strict=True):
                if row[:-4] != key:
                    if stack:
                        yield blocks()
                    key, stack = row[:-4], []
                block = row[-4:]
                while stack and stack[-1][2] * block[3] >= block[2] * stack[-1][3]:
                    last = stack.pop()
                    block = (last[0], block[1], last[2] + block[2], last[3] + block[3])
                stack.append(block)
        if stack:
            yield blocks()

    return lambda df: df.mapInPandas(pool, schema)


def isotonic_blocks(pooled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks ``keys, lo, hi, s, w`` of the weighted monotone fit, by pool-adjacent-violators.

    ``pooled``: one row per distinct value, ``keys, x, s, w`` (sum of labels, rows; keys not null). Violators are pooled
    inside value ranges, then the ranges' block stacks in fewer and fewer ranges, until one holds them all.
    """
    blocks = pooled.select(*keys, F.col("x").alias("lo"), F.col("x").alias("hi"), F.col("s").cast("bigint").alias("s"), F.col("w").cast("bigint").alias("w"))
    pool = _pool_violators(keys, blocks.schema.simpleString().removeprefix("struct<").removesuffix(">"))
    left = pooled.count()
    while True:
        ranges = -(-left // RANGE_ROWS)
        spread = blocks.repartitionByRange(max(1, ranges), *keys, "lo") if ranges > 1 else blocks.coalesce(1)
        blocks = materialise(pool(spread.sortWithinPartitions(*keys, "lo")), "blocks")
        if ranges <= 1:
            return blocks
        left = min(blocks.count(), (ranges // 2) * RANGE_ROWS)


def fit_isotonic(scores: DataFrame, horizon: int, by: Sequence[str] = ()) -> DataFrame:
    """Breakpoints ``by, h, x, y`` of a monotone calibration per horizon (and per ``by``, in one pass); the identity
    where one class is missing."""
    spark = scores.sparkSession
    keys = [*by, "h"]
    pooled = materialise(
        scores.filter("y is not null and p is not null and h is not null").groupBy(*by, F.col("h").cast("int").alias("h"), F.col("p").alias("x"))
        .agg(F.sum("y").alias("s"), F.count("*").alias("w")), "pooled")
    both = pooled.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("w").alias("w")).filter("s > 0 and s < w").select(*keys)
    blocks = isotonic_blocks(pooled.join(both, keys, "left_semi"), keys)
    curve = blocks.select(*keys, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), (F.col("s") / F.col("w")).alias("y"))
    every = (scores.select(*by).distinct() if by else spark.range(1).select()).select(*by, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    same = every.join(both, keys, "left_anti").select(*keys, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("x")).withColumn("y", F.col("x"))
    return curve.unionByName(same)


def apply_isotonic(scores: DataFrame, breakpoints: DataFrame, width: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    """Piecewise-linear calibration, clipped at the ends: a lookup of the interval around each
    score among its horizon's breakpoints."""
    keys = [*by, "h"]
    w = Window.partitionBy(*keys).orderBy("x")
    spans = breakpoints.select(
        *keys, F.col("x").alias("lo"), F.lead("x").over(w).alias("hi"), F.col("y").alias("y0"), F.lead("y").over(w).alias("y1")
    ).filter("hi > lo")
    ends = breakpoints.groupBy(*keys).agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min_by("y", "x").alias("_y0"), F.max_by("y", "x").alias("_y1")
    )
    p = F.col("p")
    j = interval_lookup(scores, spans, keys, "p", ["y0", "y1"], width).join(ends, keys, "left")
    inner = F.col("y0") + (p - F.col("lo")) / (F.col("hi") - F.col("lo")) * (F.col("y1") - F.col("y0"))
    cal = F.when(p <= F.col("_x0"), F.col("_y0")).when(p >= F.col("_x1"), F.col("_y1")).otherwise(inner)
    return j.withColumn("p_cal", F.coalesce(cal, p)).select(*scores.columns, "p_cal")


# --- stacking and comparison --------------------------------------------------------------


def wide_by_model(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per example and horizon with the models' probabilities as an array."""
    cols = [F.max(F.when(F.col("model") == m, F.col("p"))) for m in models]
    return scores.groupBy("example_id", "h").agg(F.array(*cols).alias("ps"), F.max("y").alias("y"))


def _dot(beta, xs):
    return F.aggregate(F.zip_with(beta, xs, lambda b, x: b * x), F.lit(0.0), lambda a, v: a + v)


def logistic_by_key(rows: DataFrame, key: str, width: int, ridge: str = "ridge", rounds: int = 50, tol: float = 1e-9) -> DataFrame:
    """``key, beta`` (intercept first): a logistic regression per key, all keys in one pass per Newton round.

    ``rows``: key, ``xs`` (array of ``width``), ``y`` 0 or 1, and the key's ``ridge``, the weight of half the squared
    slopes against the sum of log losses. Each round sums the normal equations per key, (width + 1) * (width + 4) / 2
    numbers; the driver solves one small system per key, and halves a step that does not lower the loss.
    """
    spark, n = rows.sparkSession, width + 1
    tri = [(i, j) for i in range(n) for j in range(i, n)]
    data = materialise(rows.select(key, F.array_insert("xs", 1, F.lit(1.0)).alias("z"), F.col("y").cast("double").alias("y"), ridge), "stack")
    beta = {r[key]: np.zeros(n) for r in data.select(key).distinct().collect()}  # one entry per key
    step, loss, live = {k: np.zeros(n) for k in beta}, {}, set(beta)
    for _ in range(rounds):
        table = spark.createDataFrame([(k, (beta[k] + step[k]).tolist()) for k in sorted(live)], f"{key} {data.schema[key].dataType.simpleString()}, beta array<double>")
        eta = _dot(F.col("beta"), F.col("z"))
        fit = data.join(table, key).withColumn("eta", eta).withColumn("m", 1 / (1 + F.exp(-F.col("eta"))))
        z, v = (lambda i: F.get("z", F.lit(i))), F.col("m") * (1 - F.col("m"))
        hinge = F.greatest(F.col("eta"), F.lit(0.0)) - F.col("eta") * F.col("y") + F.log1p(F.exp(-F.abs("eta")))
        sums = fit.groupBy(key).agg(
            F.max(ridge).alias("ridge"), F.sum(hinge).alias("loss"), F.array(*[F.sum((F.col("m") - F.col("y")) * z(i)) for i in range(n)]).alias("_grad"),
            F.array(*[F.sum(v * z(i) * z(j)) for i, j in tri]).alias("_hess")).collect()  # one small system per key
        for r in sums:
            k = r[key]
            at = beta[k] + step[k]
            pull = np.array([0.0] + [r.ridge] * width)
            now = r.loss + 0.5 * float(pull @ at**2)
            if k in loss and now > loss[k] + 1e-12 * abs(loss[k]):
                step[k] = step[k] / 2
                continue
            hessian = np.diag(pull)
            for (i, j), x in zip(tri, r["_hess"], strict=True):
                hessian[i, j] += x
                hessian[j, i] += x if i != j else 0.0
            move = -np.linalg.lstsq(hessian, np.array(r["_grad"]) + pull * at, rcond=None)[0]
            beta[k], loss[k], step[k] = at, now, move
            if np.abs(move).max() < tol:
                live.discard(k)
        live = {k for k in live if np.abs(step[k]).max() >= tol}
        if not live:
            break
    return spark.createDataFrame([(k, b.tolist()) for k, b in sorted(beta.items())], f"{key} {data.schema[key].dataType.simpleString()}, beta array<double>")


def ensemble_stack(val: DataFrame, test: DataFrame, models: Sequence[str], horizon: int) -> DataFrame:
    """Logistic regression over the models' validation outputs per horizon, applied to test;
    the plain mean where validation has one class. Output ``example_id, h, p, y``.

    All horizons are fitted together; an example that lacks a model's output teaches nothing and is stacked as null."""
    wv = wide_by_model(val, models).filter(F.col("h").between(1, horizon))
    wt = wide_by_model(test, models).filter(F.col("h").between(1, horizon))
    known = materialise(wv.filter("y is not null and not exists(ps, x -> x is null)"), "known")
    both = known.groupBy("h").agg(F.avg("y").alias("m")).filter("m > 0 and m < 1").select("h", F.lit(1.0).alias("ridge"))
    fitted = logistic_by_key(known.join(both, "h").withColumnRenamed("ps", "xs"), "h", len(models))
    # arithmetic spelled out: no lambda travels with the rows
    lacks = reduce(lambda a, b: a | b, [F.col("ps")[i].isNull() for i in range(len(models))])
    mean = sum((F.col("ps")[i] for i in range(len(models))), F.lit(0.0)) / len(models)
    eta = sum((F.col("beta")[i + 1] * F.col("ps")[i] for i in range(len(models))), F.col("beta")[0])
    p = F.when(lacks, F.lit(None)).when(F.col("beta").isNull(), mean).otherwise(1 / (1 + F.exp(-eta)))
    return wt.join(fitted, "h", "left").select("example_id", "h", p.alias("p"), "y")


def tune_and_score(val: DataFrame, test: DataFrame, strategy: str = "f2") -> DataFrame:
    """Per model and horizon: threshold from validation, metrics and area on test."""
    from .scoring import score_metrics

    keys = ("model", "h")
    thr = pick_threshold(val, strategy, keys)
    return score_metrics(test, thr, keys).join(average_precision(test, keys), list(keys), "left").fillna(0.0, ["pr_auc"])


def calibrated_twins(scores: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """Every model's scores, and again under ``<model>_cal`` by the breakpoints of that model."""
    cols = ["model", "example_id", "h", "p", "y"]
    cal = apply_isotonic(scores.select(*cols), breakpoints, by=["model"])
    return scores.select(*cols).unionByName(
        cal.select(F.concat("model", F.lit("_cal")).alias("model"), "example_id", "h", F.col("p_cal").alias("p"), "y"))


def model_compare(val: DataFrame, test: DataFrame, horizon: int, step_s: int = 60) -> DataFrame:
    """Every model and its calibrated twin: tuned on validation, scored on test, best first."""
    from .scoring import headline_rollup

    breakpoints = materialise(fit_isotonic(val, horizon, by=["model"]), "breakpoints")  # all models in one pass
    metrics = tune_and_score(calibrated_twins(val, breakpoints), calibrated_twins(test, breakpoints))
    return headline_rollup(metrics, step_s, ("model",)).orderBy(F.desc("mean_f2_5_30"), F.desc("mean_pr_auc"), "model")


# --- importance ---------------------------------------------------------------------------


def permuted_channel(examples: DataFrame, channel: int, n_channels: int, seed: int = 2026, buckets: int = 1024) -> DataFrame:
    """Examples with one channel (all its ticks) taken from another row.

    All rows stand in one random order and each takes the channel of the next; the last takes the first's. The order
    is cut into buckets by its hash, and a bucket's last row finds its successor among the buckets' first rows.
    """
    mix = F.xxhash64(F.lit(seed), F.lit(channel), "example_id")
    rows = examples.withColumns({"_mix": mix, "_bucket": F.pmod(mix, F.lit(buckets))})
    heads = rows.groupBy("_bucket").agg(F.min_by("features", F.struct("_mix", "example_id")).alias("_head"))
    order = Window.orderBy("_bucket")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("_bucket", F.coalesce(F.lead("_head").over(order), F.first("_head").over(whole)).alias("_after"))
    w = Window.partitionBy("_bucket").orderBy("_mix", "example_id")
    rows = rows.withColumn("_next", F.lead("features").over(w)).join(heads, "_bucket").withColumn("_other", F.coalesce("_next", "_after"))
    swapped = F.transform(F.arrays_zip(F.col("features").alias("a"), F.col("_other").alias("b")),
                          lambda z, i: F.when(i % n_channels == channel, z["b"]).otherwise(z["a"]))
    return rows.withColumn("features", swapped).drop("fv", "_bucket", "_mix", "_next", "_after", "_other")


def permutation_importance(val: DataFrame, fitted: HorizonModels, channel_names: Sequence[str], seed: int = 2026) -> DataFrame:
    """Drop of the mean area over horizons when a channel is shuffled across rows."""
    n = len(channel_names)

    def area(df: DataFrame, name: str) -> DataFrame:
        long = to_long(predict_horizons(df, fitted), keep=("example_id",)).withColumn("channel", F.lit(name))
        return average_precision(long, ("channel", "h")).filter("pr_auc > 0").groupBy("channel").agg(F.avg("pr_auc").alias("area"))

    base = area(val, "").select(F.col("area").alias("base"))
    shuffled = None
    for i, name in enumerate(channel_names):
        part = area(permuted_channel(val, i, n, seed), name)
        shuffled = part if shuffled is None else shuffled.unionByName(part)
    return shuffled.withColumn("importance", base.scalar() - F.col("area")).select("channel", "importance")


def node_tables(spark, fitted: Sequence[HorizonModels]) -> DataFrame:
    """``bag, h, tree, node, feature, gain, rows, left, right``: every node of every tree of all bags and horizons.

    The fitted models are saved to the shared folder and their node tables read back as one frame. ``gain`` is the
    impurity a split takes from a row on average, ``rows`` the weight that reaches the node; a leaf has no feature.
    """
    root = shared_dir(spark, "trees")
    some = False
    for b, bag in enumerate(fitted):
        for h, model in enumerate(bag.models):
            if model is not None:
                model.write().save(f"{root}/bag={b}/h={h + 1}")
                some = True
    if not some:
        return spark.createDataFrame([], "bag int, h int, tree int, node int, feature int, gain double, rows double, left int, right int")
    n = "nodeData."
    read = spark.read.option("basePath", root).parquet(f"{root}/bag=*/h=*/data")
    split = F.col(f"{n}leftChild") >= 0
    return read.select(
        "bag", "h", F.col("treeID").alias("tree"), F.col(f"{n}id").alias("node"), F.when(split, F.col(f"{n}split.featureIndex")).alias("feature"),
        F.when(split, F.col(f"{n}gain")).alias("gain"), F.col(f"{n}impurityStats")[0].alias("rows"), F.col(f"{n}leftChild").alias("left"), F.col(f"{n}rightChild").alias("right"))


def gain_importance(spark, fitted: Sequence[HorizonModels], channel_names: Sequence[str], ticks: int) -> DataFrame:
    """``channel, tick, gain, gain_pct``: raw split gain summed over all trees, bags and horizons.

    A split's raw gain is the impurity it takes from all rows that reach it. Features are laid out tick by tick.
    """
    names = [(c, t) for t in range(ticks) for c in channel_names]
    every = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(names)], "feature int, channel string, tick int")
    gains = node_tables(spark, fitted).filter("feature is not null").groupBy("feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("gain"))
    out = every.join(gains, "feature", "left").select("channel", "tick", F.coalesce("gain", F.lit(0.0)).alias("gain"))
    whole = out.agg(F.sum("gain"))
    return out.withColumn("gain_pct", F.coalesce(F.try_divide(100.0 * F.col("gain"), whole.scalar()), F.lit(0.0)))
