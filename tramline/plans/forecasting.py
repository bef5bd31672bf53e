"""Examples, training and scoring as whole-table jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..defaults import NO_LEADER_GAP_M
from ..operators import buses, detect, examples, learn, scoring
from ..session import materialise
from ..sources import store


def build_examples(
    traj: DataFrame,
    route_stops: DataFrame,
    route_id: str | None = None,
    since=None,
    until=None,
    headways: DataFrame | None = None,
    stale_s: float | None = None,
    **geometry,
) -> DataFrame:
    """Stored trajectories to labelled examples; route and dates are partition filters."""
    rows = traj if route_id is None else traj.filter(F.col("route_id") == route_id)
    if since is not None:
        rows = rows.filter(F.col("service_date") >= since)
    if until is not None:
        rows = rows.filter(F.col("service_date") <= until)
    cut = {} if stale_s is None else {"stale_s": stale_s}
    return examples.labelled_examples(buses.group_into_buses(rows, route_stops, **cut), headways=headways, **geometry)


def with_features(examples: DataFrame, scaler: DataFrame, rich: bool = True, channels: int = 6) -> DataFrame:
    """Scaled, flat feature array next to the labels."""
    scaled = scoring.scale_window(examples, scaler, channels)
    return scaled.withColumn("features", scoring.flat_features(F.col("window"), F.col("extras") if rich else None))


@dataclass
class Forecaster:
    """What training leaves behind: small tables and fitted models."""

    scaler: DataFrame
    bags: list
    breakpoints: DataFrame
    thresholds: DataFrame
    horizon: int
    length: int
    step_s: int


def train_calibrate(train: DataFrame, val: DataFrame, horizon: int, length: int, step_s: int = 60, bags: int = 8,
                    strategy: str = "precision@0.30", seed: int = 2026, **params) -> Forecaster:
    """Scaler, bagged models, calibration and thresholds. Features are written once and read by
    every fit."""
    scaler = materialise(scoring.feature_scaler(train), "scaler")
    tr_rows = learn.stored_rows(with_features(train, scaler), "train")
    va_rows = learn.stored_rows(with_features(val, scaler), "val")
    fitted = learn.train_bag(tr_rows, va_rows, horizon, bags, seed, **params)
    raw = scoring.to_long(learn.predict_bag(va_rows, fitted).withColumn("labels", F.slice("labels", 1, horizon)))
    raw = materialise(raw, "val-scores")
    breakpoints = materialise(learn.fit_isotonic(raw, horizon), "breakpoints")
    cal = learn.apply_isotonic(raw, breakpoints).select("example_id", "h", F.col("p_cal").alias("p"), "y")
    thresholds = materialise(scoring.pick_threshold(cal, strategy), "thresholds")
    return Forecaster(scaler, fitted, breakpoints, thresholds, horizon, length, step_s)


def score(examples: DataFrame, model: Forecaster) -> DataFrame:
    """Calibrated probability vector per example."""
    scored = materialise(learn.predict_bag(with_features(examples, model.scaler), model.bags), "predicted")
    long = scored.select("example_id", F.posexplode("probs").alias("_h", "p")).withColumn("h", F.col("_h") + 1)
    cal = learn.apply_isotonic(long, model.breakpoints).groupBy("example_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("h", "p_cal"))), lambda x: x["p_cal"]).alias("cal"))  # H entries
    return scored.join(cal, "example_id").withColumn("probs", F.col("cal")).drop("cal")


def score_on_grid(examples: DataFrame, model: Forecaster, step_s: int, horizon: int) -> DataFrame:
    """Probabilities of a model that was trained on another history length and step, on the grid of ``step_s`` and ``horizon``.

    Windows (and their context) shorter than the model's are led in by their first tick, longer ones give their last
    ticks; entry +k of the answer is the model's entry at the same lead time, held at its ends.
    """
    cut = {"window": scoring.pad_history(F.col("window"), model.length)}
    if "extras" in examples.columns:
        cut["extras"] = scoring.pad_history(F.col("extras"), model.length)
    scored = score(examples.withColumns(cut), model)
    return scored.withColumn("probs", scoring.horizon_remap(F.col("probs"), model.step_s, step_s, horizon))


def threshold_array(thresholds: DataFrame):
    """Thresholds as one array value, in horizon order."""
    return thresholds.agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "threshold"))), lambda x: x["threshold"])).scalar()


def evaluate(scored: DataFrame, model: Forecaster) -> DataFrame:
    """Per-horizon metrics with the area under precision and recall."""
    long = scoring.to_long(scored.withColumn("labels", F.slice("labels", 1, model.horizon)))
    return scoring.score_metrics(long, model.thresholds).join(scoring.average_precision(long), "h", "left").fillna(0.0, ["pr_auc"])


@dataclass
class EvaluationReport:
    """Small tables: one row per horizon, one in all, one per period of the day, one per reliability bin."""

    per_horizon: DataFrame
    headline: DataFrame
    per_period: DataFrame
    reliability: DataFrame


def evaluation_report(scored: DataFrame, thresholds: DataFrame, horizon: int, step_s: int = 60) -> EvaluationReport:
    """Everything an operator is judged by, from scored examples (``example_id, probs, labels, t_ref_min``).

    Per horizon: counts, precision, recall, F2 and Brier at the threshold, area, and recall at each precision target.
    The headline, the periods and the reliability bins take the horizons of 1 to 30 minutes; alerts per bus-hour count
    examples that fire at any horizon.
    """
    rows = materialise(scored.select("example_id", "probs", F.slice("labels", 1, horizon).alias("labels"), "t_ref_min"), "report-rows")
    long = materialise(scoring.to_long(rows, keep=("example_id", "t_ref_min")), "report-scores")
    per_horizon = materialise(
        scoring.score_metrics(long, thresholds).join(scoring.average_precision(long), "h", "left").fillna(0.0, ["pr_auc"])
        .join(scoring.recall_at_precision(long), "h", "left"), "report-horizons")
    limits = threshold_array(thresholds)
    band = scoring.in_band(per_horizon, step_s)
    reach = [c for c in per_horizon.columns if c.startswith("recall_at_")]
    fires = scoring.alerts_per_bus_hour(rows, limits, step_s)
    means = band.agg(*[F.avg(c).alias(f"mean_{c}") for c in reach])
    headline = scoring.headline_rollup(per_horizon, step_s).select(
        "*", *[means.select(f"mean_{c}").scalar().alias(f"mean_{c}") for c in reach], fires.scalar().alias("alerts_per_bus_hour"),
        F.lit(min(30.0, horizon * step_s / 60.0)).alias("band_min"), rows.agg(F.count("*")).scalar().alias("examples"))
    return EvaluationReport(per_horizon, headline, scoring.period_report(rows, long, thresholds, limits, step_s),
                            scoring.reliability_bins(scoring.in_band(long, step_s)))


def build_dataset(traj: DataFrame, route_stops: DataFrame, folder: str, train: float = 0.70, val: float = 0.15, **options) -> DataFrame:
    """Labelled examples as shards per date and direction, with a manifest, the settings and the chronological split.

    Returns the split as written to ``<folder>/split``: date, split, examples. ``store.scan_example_split`` reads a part.
    """
    spark = traj.sparkSession
    settings = {k: str(v) for k, v in options.items() if isinstance(v, (int, float, str, bool))}
    store.write_example_shards(build_examples(traj, route_stops, **options), folder,
                               spark.createDataFrame([(settings, train, val)], "settings map<string,string>, train double, val double"))
    counts = store.read_manifest(spark, folder)
    split = counts.groupBy("service_date").agg(F.sum("n_examples").alias("n_examples")).join(store.date_split(counts, train, val), "service_date")
    split.coalesce(1).write.mode("overwrite").parquet(f"{folder}/split")
    return spark.read.parquet(f"{folder}/split")


# --- live slices --------------------------------------------------------------------------


def within_reach(points: DataFrame, refs: DataFrame, back_s: float, ahead_s: float) -> DataFrame:
    """Points with each reference time of their slice from which they are at most ``back_s`` before or ``ahead_s`` after.

    Time is cut into cells as long as that reach; a point lies in one, a reference is listed under the two or three
    cells it can need. So a point meets the references around it, not all of its slice's.
    """
    width = float(back_s + ahead_s)
    t = F.unix_micros("datetime") / 1e6
    cell = lambda x: F.floor(x / width)
    asked = refs.select(*buses.SLICE, "t_ref").distinct().withColumn(
        "_cell", F.explode(F.sequence(cell(F.col("t_ref") - back_s), cell(F.col("t_ref") + ahead_s))))
    return (
        points.withColumn("_cell", cell(t)).join(asked, [*buses.SLICE, "_cell"])
        .filter(t.between(F.col("t_ref") - back_s, F.col("t_ref") + ahead_s)).drop("_cell")
    )


def eligibility(points: DataFrame, refs: DataFrame, length: int, step_s: int = 60, freshness_s: float = 90.0, edge: int = 2) -> DataFrame:
    """For every bus of every slice with a reference time: can it be scored, and if not why.

    ``refs``: slice columns and ``t_ref`` (epoch seconds), any number per slice. The first
    reason that holds wins, in the order stale, no sample at the reference, stop band, missing
    history, no leader. Adds the neighbours' window where there is one. ``age_s`` is null where
    nothing was seen within the time that any reason looks back.
    """
    match_s = max(5.0, step_s / 2.0)
    keys = [*detect.BUS, "t_ref"]
    rows = within_reach(points, refs, back_s=max(freshness_s, (length + 1) * step_s), ahead_s=max(match_s, 2.0 * step_s))
    t = F.unix_micros("datetime") / 1e6
    off = F.abs(t - F.col("t_ref"))
    near = F.when(off <= match_s, F.struct(off, t))
    who = points.select(*detect.BUS, *examples.IDENTITY, "num_stops").distinct().join(refs.select(*buses.SLICE, "t_ref"), buses.SLICE)
    seen = rows.groupBy(*keys).agg(
        (F.col("t_ref") - F.max(F.when(t <= F.col("t_ref"), t))).alias("age_s"),
        F.min_by(F.struct("stop_index", "travel_distance_m"), near).alias("ref"),
        F.min(near).isNotNull().alias("has_ref"),
    )
    state = who.join(seen, keys, "left")
    state = state.select(*keys, *examples.IDENTITY, "num_stops", "age_s",
                         F.when(F.col("has_ref"), F.col("ref.stop_index")).alias("ref_stop"),
                         F.when(F.col("has_ref"), F.col("ref.travel_distance_m")).alias("ref_dist"))
    grid = examples.grid_track(rows, step_s, 2.0 * step_s, "nearest", "t_ref").filter(F.col("k").between(-(length - 1), 0))
    chain = examples.with_ticks(examples.leader_chain(grid, ("t_ref",)), length, step_s, anchor="t_ref")
    hist = chain.groupBy(*keys).agg(
        F.count("*").alias("ticks"), F.min("fwd_gap_m").alias("closest"),
        F.array_sort(F.collect_list("_tick")).alias("hist"))  # length entries
    j = state.join(hist, keys, "left")
    si = F.rint("ref_stop")
    why = (
        F.when(F.col("age_s").isNull() | (F.col("age_s") > freshness_s), "stale")
        .when(F.col("ref_stop").isNull(), "no_ref_sample")
        .when((si < edge) | (si >= F.col("num_stops") - edge), "edge_band")
        .when(F.coalesce("ticks", F.lit(0)) < length, "missing_history")
        .when(F.col("closest") >= NO_LEADER_GAP_M, "no_leader")
    )
    return j.withColumn("reason", why).withColumns(
        {"eligible": F.col("reason").isNull(), "running": F.col("reason").isNull() | F.col("reason").isin("edge_band", "no_leader")})


def score_slices(points: DataFrame, refs: DataFrame, model: Forecaster, freshness_s: float = 90.0, edge: int = 2,
                 cap_minutes: int | None = None) -> DataFrame:
    """One row per bus and reference time of all slices: eligibility, truncated probabilities
    and alert state (null where not eligible)."""
    state = materialise(eligibility(points, refs, model.length, model.step_s, freshness_s, edge), "state")
    if "shape_length_m" in points.columns:
        lengths = points.groupBy(*buses.SLICE).agg(F.max("shape_length_m").alias("shape_length_m"))
        state = state.join(lengths, buses.SLICE)
    else:
        state = state.withColumn("shape_length_m", F.lit(None).cast("double"))
    h = F.col("hist")
    speeds = F.transform(h, lambda x: x["v"])
    moving = F.filter(speeds, lambda v: v >= 0.5)
    base = F.array_sort(F.when(F.size(moving) > 0, moving).otherwise(speeds))
    n = F.size(base)
    lb = max(1, min(3, model.length - 1))
    last, prev = F.element_at(h, -1)["gap"], F.get(h, F.size(h) - 1 - lb)["gap"]
    closing = F.when((last < NO_LEADER_GAP_M) & (prev < NO_LEADER_GAP_M), (prev - last) / (lb * model.step_s)).otherwise(0.0)
    ready = state.filter("eligible").withColumns({
        "example_id": F.concat_ws("|", *buses.SLICE, "bus_id", "t_ref"),
        "window": examples.window_channels(h), "extras": examples.context_features(4, model.length, model.step_s),
        "median_speed": (F.get(base, ((n - 1) / 2).cast("int")) + F.get(base, (n / 2).cast("int"))) / 2,
        "forward_gap_m": last, "gap_closure_m_s": closing,
    })
    scored = score(ready, model).withColumn("useful_horizon_steps", scoring.useful_horizon(
        F.col("ref_dist"), F.col("shape_length_m"), F.col("median_speed"), model.step_s, model.horizon, cap_minutes))
    alerts = scoring.alert_summary(scored, threshold_array(model.thresholds), F.col("useful_horizon_steps"))
    keys = [*detect.BUS, "t_ref"]
    out = alerts.select(*keys, "example_id", "features", "probs", "any_alert", "first_alert_step", "max_prob", "max_prob_step", "per_horizon",
                        "useful_horizon_steps", "forward_gap_m", "gap_closure_m_s")
    return state.select(*keys, *examples.IDENTITY, "eligible", "running", "reason", F.col("ref_stop").alias("stop_idx")).join(out, keys, "left")


def horizon_summary(scored: DataFrame, model: Forecaster) -> DataFrame:
    """Per slice, reference time and horizon: alert rate and mean probability over eligible
    buses, untruncated, with the running and eligible counts."""
    keys = [*buses.SLICE, "t_ref"]
    n = scored.groupBy(*keys).agg(F.count("*").alias("buses"), F.count_if("running").alias("running"), F.count_if("eligible").alias("eligible"))
    each = scored.filter("eligible").select(*keys, F.posexplode("probs").alias("_h", "p")).withColumn("h", F.col("_h") + 1)
    rate = each.join(model.thresholds.select("h", "threshold"), "h").groupBy(*keys, "h").agg(
        F.avg((F.col("p") >= F.col("threshold")).cast("int")).alias("alert_rate"), F.avg("p").alias("mean_prob"))
    return rate.join(n, keys)


def forecast_time_scan(points: DataFrame, dates_at_midnight: DataFrame, length: int, step_s: int = 60,
                       first_min: int = 360, last_min: int = 1320, every_min: int = 30) -> DataFrame:
    """Reference minute of the day with most eligible buses per slice (the earliest on ties).
    ``dates_at_midnight``: slice columns and ``midnight`` (epoch seconds of local midnight)."""
    refs = dates_at_midnight.select(*buses.SLICE, "midnight", F.explode(F.sequence(F.lit(first_min), F.lit(last_min), F.lit(every_min))).alias("minute")).withColumn(
        "t_ref", F.col("midnight") + F.col("minute") * 60)
    per = eligibility(points, refs, length, step_s).groupBy(*buses.SLICE, "t_ref").agg(F.count_if("eligible").alias("eligible"))
    return per.groupBy(*buses.SLICE).agg(F.max_by(F.struct("t_ref", "eligible"), F.struct("eligible", -F.col("t_ref"))).alias("b")).select(
        *buses.SLICE, "b.t_ref", "b.eligible")
