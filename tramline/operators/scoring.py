"""Forecast maths on columns: scaling, baseline, alerts, thresholds, metrics.

Two layouts. Wide: one row per example with arrays over horizons. Long: ``example_id, h, p, y``
(plus ``model`` where several are compared); a null ``y`` is an unknown label and is ignored.
Horizons count from 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..defaults import DEFAULTS, NO_LEADER_GAP_M
from ..session import materialise
from .order_stats import exact_quantiles
from .sequence import cumulative_by_value

# Speed and gap channel positions of the two history layouts.
SPEED_GAP = {9: ((0, 3, 6), (1, 4, 7)), 6: ((0, 2, 4), (1, 3, 5))}
# Local-time periods in minutes of the day, and precision floors of interest.
PERIODS = (("am_peak", 420, 570), ("midday", 570, 900), ("pm_peak", 900, 1110), ("evening", 1110, 1380))
PRECISION_TARGETS = (0.20, 0.30, 0.40, 0.50, 0.60)


# --- features -----------------------------------------------------------------------------


def feature_scaler(examples: DataFrame, channels: int = 6) -> DataFrame:
    """One row: mean and population spread of all speed and of all gap channels (a zero spread
    becomes one)."""
    speed, gap = SPEED_GAP[channels]
    tick = examples.select(F.explode("window").alias("x"))
    pool = tick.select(F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col("x")[i].alias("v")) for kind, idx in (("s", speed), ("g", gap)) for i in idx
    ])).alias("z"))
    s, g = F.when(F.col("z.kind") == "s", F.col("z.v")), F.when(F.col("z.kind") == "g", F.col("z.v"))
    one = lambda c: F.when(c == 0, 1.0).otherwise(c)
    return pool.agg(
        F.avg(s).alias("speed_mean"), one(F.stddev_pop(s)).alias("speed_std"),
        F.avg(g).alias("gap_mean"), one(F.stddev_pop(g)).alias("gap_std"),
    )


def scale_window(examples: DataFrame, scaler: DataFrame, channels: int = 6) -> DataFrame:
    """Z-score the speed and gap channels of ``window``; the scaler is a one-row frame."""
    speed, gap = SPEED_GAP[channels]
    s = scaler.select(F.struct("speed_mean", "speed_std", "gap_mean", "gap_std")).scalar()
    rows = examples.withColumn("_s", s)

    def tick(x: Column) -> Column:
        z = []
        for i in range(channels):
            if i in speed:
                z.append((x[i] - F.col("_s.speed_mean")) / F.col("_s.speed_std"))
            elif i in gap:
                z.append((x[i] - F.col("_s.gap_mean")) / F.col("_s.gap_std"))
            else:
                z.append(x[i])
        return F.array(*z)

    return rows.withColumn("window", F.transform("window", tick)).drop("_s")


def flat_features(window: Column, extras: Column | None = None) -> Column:
    """Tick-major flat feature array, history alone or history with context."""
    if extras is None:
        return F.flatten(window)
    return F.flatten(F.zip_with(window, extras, lambda a, b: F.concat(a, b)))


def horizon_remap(probs: Column, from_step_s: int, to_step_s: int, to_horizon: int) -> Column:
    """Read a vector made at one step on the grid of another, holding the last entry."""
    n = F.size(probs)
    return F.transform(F.sequence(F.lit(1), F.lit(to_horizon)), lambda h: F.get(
        probs, F.least(n - 1, F.greatest(F.lit(0), F.floor(h * to_step_s / from_step_s).cast("int") - 1))))


def pad_history(window: Column, length: int) -> Column:
    """Left-pad with the first tick, or keep the last ``length`` ticks."""
    n = F.size(window)
    padded = F.concat(F.array_repeat(window[0], F.greatest(F.lit(0), F.lit(length) - n)), window)
    return F.slice(padded, F.size(padded) - length + 1, length)


# --- baseline and alerts ------------------------------------------------------------------


def physics_baseline(window: Column, horizon: int, step_s: int = DEFAULTS.step_s, threshold_m: float = DEFAULTS.label_gap_m,
                     width_m: float = 50.0, lookback: int = 3, min_closing: float = -0.1) -> Column:
    """Probability per horizon from the gap carried forward at its recent closing rate. Zero
    without a leader, and where the gap stays far and opens."""
    n = F.size(window)
    lb = F.least(F.lit(lookback), n - 1)
    now = F.element_at(window, -1)[1]
    before = F.get(window, n - 1 - lb)[1]
    closing = F.when(lb > 0, (before - now) / (lb * float(step_s))).otherwise(0.0)

    def at(h: Column) -> Column:
        ahead = F.greatest(F.lit(0.0), now - closing * (h * step_s))
        p = 1.0 / (1.0 + F.exp(-(threshold_m - ahead) / max(width_m, 1.0)))
        opening = (ahead > threshold_m + 6 * width_m) & (closing < min_closing)
        return F.when(opening | (now >= NO_LEADER_GAP_M * 0.99), 0.0).otherwise(p)

    return F.transform(F.sequence(F.lit(1), F.lit(horizon)), at)


def collapse_probability(probs: Column, mode: str = "max") -> Column:
    if mode == "max":
        return F.array_max(probs)
    if mode == "last":
        return F.element_at(probs, -1)
    if mode == "mean":
        return F.aggregate(probs, F.lit(0.0), lambda a, x: a + x) / F.size(probs)
    raise ValueError(f"unknown mode {mode!r}")


def useful_horizon(distance: Column, length: Column, speed: Column, step_s: int, horizon: int,
                   cap_minutes: int | None = None, safety: float = 1.5, floor_speed: float = 1.0, minimum: int = 3) -> Column:
    """Horizons a bus can still reach before its terminus; all of them if an input is missing."""
    remaining_s = F.greatest(F.lit(0.0), length - distance) / F.greatest(speed, F.lit(floor_speed))
    steps = F.greatest(F.lit(minimum), F.least(F.lit(horizon), F.floor(safety * remaining_s / step_s)))
    known = distance.isNotNull() & length.isNotNull() & speed.isNotNull()
    out = F.when(known, steps).otherwise(horizon).cast("int")
    return out if cap_minutes is None else F.least(out, F.lit(max(1, cap_minutes * 60 // max(1, step_s))))


def alert_summary(scored: DataFrame, thresholds: Column, useful: Column | None = None) -> DataFrame:
    """Alert state over the useful prefix: any, first step over its threshold, top probability
    and its step (steps count from 0), and the prefix itself."""
    n = F.greatest(F.lit(0), F.least(F.size("probs"), useful if useful is not None else F.size("probs")))
    rows = scored.withColumn("_p", F.slice("probs", 1, n)).withColumn("_t", F.slice(thresholds, 1, n))
    over = F.zip_with("_p", "_t", lambda p, t: p >= t)
    first = F.array_position("_over", F.lit(True))
    return (
        rows.withColumn("_over", over)
        .withColumns(
            {
                "any_alert": F.exists("_over", lambda x: x),
                "first_alert_step": F.when(first > 0, (first - 1).cast("int")),
                "max_prob": F.coalesce(F.array_max("_p"), F.lit(0.0)),
                "max_prob_step": F.greatest(F.lit(0), F.coalesce(F.array_position("_p", F.array_max("_p")), F.lit(1)).cast("int") - 1),
                "per_horizon": F.col("_p"),
            }
        )
        .drop("_p", "_t", "_over")
    )


def alerts_per_bus_hour(scored: DataFrame, thresholds: Column, step_s: int = DEFAULTS.step_s, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows with any alert, per hour of reference ticks."""
    fired = F.exists(F.zip_with("probs", "_limits", lambda p, t: p >= t), lambda x: x)
    return scored.withColumn("_limits", thresholds).groupBy(*by).agg((F.avg(fired.cast("int")) * 3600.0 / max(1, step_s)).alias("alerts_per_bus_hour"))


def to_long(scored: DataFrame, probs: str = "probs", labels: str = "labels", keep: Sequence[str] = ("example_id",)) -> DataFrame:
    return scored.select(*keep, F.posexplode(F.arrays_zip(F.col(probs).alias("p"), F.col(labels).alias("y"))).alias("_h", "z")).select(
        *keep, (F.col("_h") + 1).alias("h"), "z.p", "z.y")


# --- thresholds and metrics ---------------------------------------------------------------


def f_beta(p: Column, r: Column, beta: float) -> Column:
    b2 = beta * beta
    return F.when(p + r <= 0, 0.0).otherwise(F.try_divide((1 + b2) * p * r, b2 * p + r))


def _grid_value(i: Column) -> Column:
    return 0.01 + (i - 1) * 0.01


def pick_threshold(scores: DataFrame, strategy: str = "f2", keys: Sequence[str] = ("h",)) -> DataFrame:
    """Best threshold of 0.01 … 0.98 per key.

    ``f0.5``, ``f1`` and ``f2`` maximise F; ``precision@X`` maximises recall with precision of
    at least X, and gives 0.99 where that is out of reach. The lowest threshold wins ties.
    Scores are counted once per grid step, then summed from the top: 98 small rows per key
    stand for the whole table.
    """
    steps = 98
    k = F.floor(F.col("p") * 100).cast("int")
    k = F.when(F.col("p") < _grid_value(k), k - 1).when(F.col("p") >= _grid_value(k + 1), k + 1).otherwise(k)
    cell = F.least(F.lit(steps), F.greatest(F.lit(0), k))
    counts = scores.filter("y is not null").groupBy(*keys, cell.alias("i")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    dense = counts.groupBy(*keys).agg(F.sum("pos").alias("all_pos")).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    at_or_over = Window.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    cum = dense.join(counts, [*keys, "i"], "left").withColumns(
        {"tp": F.coalesce(F.sum("pos").over(at_or_over), F.lit(0)), "fp": F.coalesce(F.sum("neg").over(at_or_over), F.lit(0))})
    prec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = F.col("tp") / F.greatest(F.lit(1), F.col("all_pos"))
    rows = cum.withColumns({"precision": prec, "recall": rec, "threshold": _grid_value(F.col("i"))})
    fires = (F.col("tp") + F.col("fp")) > 0
    if strategy.startswith("precision@"):
        floor = float(strategy.split("@", 1)[1])
        if not 0.0 < floor < 1.0:
            raise ValueError(f"precision target must be between 0 and 1, got {floor}")
        metric, ok, default = F.col("recall"), fires & (F.col("precision") >= floor), 0.99
    elif strategy in ("f0.5", "f1", "f2"):
        metric, ok, default = f_beta(F.col("precision"), F.col("recall"), float(strategy[1:])), fires, 0.5
    else:
        raise ValueError(f"unknown threshold strategy {strategy!r}")
    best = F.max_by(F.struct("threshold", metric.alias("metric")), F.when(ok, F.struct(metric, -F.col("threshold"))))
    return rows.groupBy(*keys).agg(F.max(F.when(ok, 1)).alias("_any"), best.alias("b")).select(
        *keys,
        F.when(F.col("_any") == 1, F.col("b.threshold")).otherwise(default).alias("threshold"),
        F.when(F.col("_any") == 1, F.greatest(F.lit(0.0), F.col("b.metric"))).otherwise(0.0).alias("metric"),
    )


def score_metrics(scores: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("h",)) -> DataFrame:
    """Per key: size, positive rate, precision, recall, F2, alerts per 100 and Brier score.
    ``thresholds`` has one row per key."""
    # the few thresholds are broadcast: a join that shuffles by horizon leaves one task per horizon
    j = scores.filter("y is not null").join(F.broadcast(thresholds.select(*keys, "threshold")), list(keys))
    hit, pos = F.col("p") >= F.col("threshold"), F.col("y") == 1
    g = j.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(pos.cast("int")).alias("pos_rate"), F.first("threshold").alias("threshold"),
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"),
        F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("_brier"), F.count_if(~pos).alias("_neg"),
    )
    one = F.lit(1)
    g = g.withColumns({"precision": F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp")),
                       "recall": F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn"))})
    both = (F.col("_neg") > 0) & (F.col("pos_rate") > 0)
    return g.select(
        *keys, "n", "pos_rate", "threshold", "precision", "recall", f_beta(F.col("precision"), F.col("recall"), 2.0).alias("f2"),
        (100.0 * (F.col("tp") + F.col("fp")) / F.col("n")).alias("alerts_per_100"), F.when(both, F.col("_brier")).alias("brier"),
    )


def _ranked(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cumulative hits and rows from the highest score down, one row per distinct score."""
    rows = scores.filter("y is not null")
    cum = cumulative_by_value(rows, keys, "p", {"tp": (F.col("y") == 1).cast("bigint"), "n": F.lit(1).cast("bigint")}, descending=True)
    totals = rows.groupBy(*keys).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count("*").alias("rows"))
    return cum.join(totals, list(keys))


def average_precision(scores: DataFrame, keys: Sequence[str] = ("h",)) -> DataFrame:
    """Step-wise area under precision and recall; zero where only one class occurs."""
    r = _ranked(scores, keys)
    area = F.sum(F.try_divide(F.col("tp"), F.col("pos")) * F.col("cum_tp") / F.col("cum_n"))
    both = F.max((F.col("pos") > 0) & (F.col("pos") < F.col("rows")))
    return r.groupBy(*keys).agg(F.when(both, area).otherwise(0.0).alias("pr_auc"))


def recall_at_precision(scores: DataFrame, targets: Sequence[float] = PRECISION_TARGETS, keys: Sequence[str] = ("h",)) -> DataFrame:
    """Best recall with precision of at least each target, null if none or only one class."""
    r = _ranked(scores, keys)
    precision, recall = F.col("cum_tp") / F.col("cum_n"), F.try_divide(F.col("cum_tp"), F.col("pos"))
    both = (F.col("pos") > 0) & (F.col("pos") < F.col("rows"))
    return r.groupBy(*keys).agg(*[
        F.max(F.when(both & (precision >= t), recall)).alias(f"recall_at_{round(t * 100)}") for t in targets])


def reliability_bins(scores: DataFrame, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Observed against predicted rate in equal bins, the last closed; empty bins stay."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins).cast("int"))
    rows = scores.filter("y is not null")
    got = rows.groupBy(*keys, b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p").alias("mean_pred"), F.avg("y").alias("obs_rate"))
    axis = rows.select(*keys, F.lit(1).alias("_k")).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).drop("_k")
    return axis.join(got, [*keys, "bin"], "left").withColumns(
        {"n": F.coalesce("n", F.lit(0)), "bin_lo": F.col("bin") / bins, "bin_hi": (F.col("bin") + 1) / bins})


def period_of(minute: Column) -> Column:
    out = F.lit("other")
    for name, lo, hi in reversed(PERIODS):
        out = F.when((minute >= lo) & (minute < hi), name).otherwise(out)
    return out


def period_breakdown(scores: DataFrame, thresholds: DataFrame, step_s: int = DEFAULTS.step_s) -> DataFrame:
    """Mean precision and recall over the horizons in band, per period of ``t_ref_min``."""
    rows = scores.withColumn("period", period_of(F.col("t_ref_min")))
    per = score_metrics(rows.select("period", "h", "p", "y"), _per_period(thresholds), ("period", "h"))
    return in_band(per, step_s).groupBy("period").agg(
        F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.sum("n").alias("labels"))


def period_report(scored: DataFrame, long: DataFrame, thresholds: DataFrame, limits: Column, step_s: int = DEFAULTS.step_s) -> DataFrame:
    """``period_breakdown`` with the examples of each period and their alerts per bus-hour. ``scored`` is wide, ``long``
    the same scores by horizon; ``limits`` the thresholds as an array."""
    timed = scored.withColumn("period", period_of(F.col("t_ref_min")))
    n = timed.groupBy("period").agg(F.count("*").alias("examples"))
    fires = alerts_per_bus_hour(timed, limits, step_s, ["period"])
    return n.join(fires, "period").join(period_breakdown(long, thresholds, step_s), "period", "left")


def _per_period(thresholds: DataFrame) -> DataFrame:
    names = [p[0] for p in PERIODS] + ["other"]
    return thresholds.select(F.explode(F.array(*[F.lit(n) for n in names])).alias("period"), "h", "threshold")


def in_band(metrics: DataFrame, step_s: int, first_min: float = 1.0, last_min: float = 30.0) -> DataFrame:
    lead = F.col("h") * step_s / 60.0
    return metrics.filter((lead >= first_min) & (lead <= last_min))


def headline_rollup(metrics: DataFrame, step_s: int = DEFAULTS.step_s, keys: Sequence[str] = ()) -> DataFrame:
    """Means over the horizons of 1 to 30 minutes, and the mean F2 over 5 to 30."""
    lead = F.col("h") * step_s / 60.0
    far = F.when((lead >= 5.0) & (lead <= 30.0), F.col("f2"))
    return in_band(metrics, step_s).groupBy(*keys).agg(
        F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.avg("pr_auc").alias("mean_pr_auc"),
        F.avg("brier").alias("mean_brier"), F.coalesce(F.avg(far), F.lit(0.0)).alias("mean_f2_5_30"))


def ensemble_mean_median(scores: DataFrame) -> DataFrame:
    """Mean and median over models per example and horizon; a group is the model list."""
    return scores.groupBy("example_id", "h").agg(
        F.avg("p").alias("ens_mean"), F.percentile("p", F.lit(0.5)).alias("ens_median"), F.max("y").alias("y"))


# --- diagnostics --------------------------------------------------------------------------


def channel_drift(features: DataFrame, column: str = "features", by: Sequence[str] = ()) -> DataFrame:
    """Mean, spread and tails per feature position of a scoring batch."""
    key = [*by, "feature_idx"]
    each = materialise(features.select(*by, F.posexplode(column).alias("feature_idx", "v")), "channels")
    shape = each.groupBy(*key).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    tails = exact_quantiles(each, key, "v", {"p01": 0.01, "p99": 0.99})
    same = [shape[k].eqNullSafe(tails[k]) for k in key]
    return shape.join(tails, same, "left").select(*[shape[k] for k in key], "mean", "std", "p01", "p99")


def spearman(df: DataFrame, x: str, y: str, sentinel: float | None = NO_LEADER_GAP_M) -> DataFrame:
    """Rank correlation of two columns (mean ranks on ties), no-leader rows left out.

    Ranks come from cumulative counts per distinct value, so no task sorts the whole table.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    if sentinel is not None:
        rows = rows.filter(F.col("x") < sentinel)

    def ranks(c: str) -> DataFrame:
        cum = cumulative_by_value(rows.select(F.lit(1).alias("_g"), c), ["_g"], c, {"n": F.lit(1).cast("bigint")})
        return cum.select(c, (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias(f"r{c}"))

    # equal pairs travel as one row with a weight
    pairs = rows.groupBy("x", "y").agg(F.count("*").alias("w")).join(ranks("x"), "x").join(ranks("y"), "y")
    w, a, b = F.col("w"), F.col("rx"), F.col("ry")
    m = pairs.agg(F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * a).alias("saa"),
                  F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"))
    cov = F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")
    spread = F.sqrt(F.col("n") * F.col("saa") - F.col("sa") * F.col("sa")) * F.sqrt(F.col("n") * F.col("sbb") - F.col("sb") * F.col("sb"))
    return m.select("n", F.try_divide(cov, spread).alias("spearman"))


def realised_precision(score_log: DataFrame, outcomes: DataFrame, thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join logged probabilities with the labels known later, per horizon. ``score_log`` and
    ``outcomes`` share ``keys`` (slice, bus, reference tick) and hold arrays."""
    j = score_log.select(*keys, "probs").join(outcomes.select(*keys, "labels"), list(keys))
    return score_metrics(to_long(j, keep=keys), thresholds)
