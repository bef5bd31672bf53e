"""Quality measurements of every stage, each a small aggregate over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..defaults import DEFAULTS
from ..functions import values
from ..session import materialise
from . import shapes
from . import trajectory as tr
from .order_stats import exact_quantiles
from .sequence import previous_in_chunks

PROFILE = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


# --- projection and speed -----------------------------------------------------------------


def filter_drop_rates(keyed: DataFrame, trips: DataFrame, segments: DataFrame,
                      max_orth_m: float = DEFAULTS.max_orthogonal_m,
                      max_speed_m_s: float = DEFAULTS.max_speed_m_s) -> DataFrame:
    """One row: rows lost at dedup, off route and to teleports, with shares of the projected."""
    clean = tr.drop_null_positions(keyed)
    need = [*tr.INSTANCE, "datetime", "longitude", "latitude", "shape_id"]
    unique = materialise(tr.attach_static_trip(tr.dedup_instance_times(clean), trips).select(*need), "unique")
    projected = materialise(shapes.projection_audit(unique, segments, max_orth_m).select(*tr.INSTANCE, "datetime", "travel_distance_m", "off_route"), "projected")
    kept = tr.teleport_filter(projected.filter(~F.col("off_route")), max_speed_m_s)
    one = projected.agg(
        F.count("*").alias("projected"), F.count_if("off_route").alias("dropped_off_route")
    ).withColumns(
        {
            "raw": keyed.agg(F.count("*")).scalar(),
            "unique": unique.agg(F.count("*")).scalar(),
            "kept": kept.agg(F.count("*")).scalar(),
        }
    )
    tele = F.col("projected") - F.col("dropped_off_route") - F.col("kept")
    return one.select(
        (F.col("raw") - F.col("unique")).alias("dropped_dedup"),
        "projected",
        "dropped_off_route",
        tele.alias("dropped_teleport"),
        F.try_divide(100 * F.col("dropped_off_route"), F.col("projected")).alias("off_route_pct"),
        F.try_divide(100 * tele, F.col("projected")).alias("teleport_pct"),
    )


def orthogonal_profile(projected: DataFrame) -> DataFrame:
    """Quantiles of the distance to the shape before any cutoff."""
    d = materialise(projected.select("orthogonal_distance_m", "off_route"), "distances")
    q = exact_quantiles(d, (), "orthogonal_distance_m", PROFILE)
    whole = d.agg(F.max("orthogonal_distance_m").alias("max_m"), (100 * F.avg(F.col("off_route").cast("int"))).alias("beyond_pct"))
    return whole.select(*[q.select(n).scalar().alias(n) for n in PROFILE], "max_m", "beyond_pct")


def wrong_shape_distance(keyed: DataFrame, trips: DataFrame, segments: DataFrame,
                         max_orth_m: float = DEFAULTS.max_orthogonal_m) -> DataFrame:
    """Instances whose timetable route contradicts the feed: how far they are from the shape
    they would be projected on, and how many points would survive the cutoff."""
    bad = tr.resolve_trip_kind(keyed, trips).filter("kind = 'mismatch'").select("trip_id", "start_date")
    rows = tr.dedup_instance_times(tr.drop_null_positions(keyed)).join(bad, ["trip_id", "start_date"], "left_semi")
    key = ["trip_id", "start_date"]
    p = materialise(shapes.projection_audit(tr.attach_static_trip(rows, trips), segments, max_orth_m).select(*key, "orthogonal_distance_m", "off_route"), "distances")
    counts = p.groupBy(*key).agg(F.count("*").alias("points"), F.count_if(~F.col("off_route")).alias("kept"))
    return counts.join(exact_quantiles(p, key, "orthogonal_distance_m", {"median_m": 0.5}), key, "left").select(*key, "median_m", "points", "kept")


def speed_bands(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of negative, borderline and impossible speeds, with quantiles."""
    v = F.col("moving_speed_m_s")
    rows = materialise(points.select(*by, "moving_speed_m_s"), "speeds")
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(v < 0).alias("negative"),
        F.count_if((v > 30) & (v <= 35)).alias("band_30_35"),
        F.count_if(v > 35).alias("over_35"),
    )
    names = ("p50", "p90", "p99")
    q = exact_quantiles(rows, by, "moving_speed_m_s", {n: PROFILE[n] for n in names})
    if not by:
        return counts.select("*", *[q.select(n).scalar().alias(n) for n in names])
    same = [counts[k].eqNullSafe(q[k]) for k in by]
    return counts.join(q, same, "left").select(*[counts[c] for c in counts.columns], *names)


def synthetic_in_gaps(points: DataFrame, resolution_s: int = DEFAULTS.resolution_s, hole_s: float = 120.0) -> DataFrame:
    """How many resampled rows each real pair would get, and the share inside long holes. The
    count per pair is arithmetic, so nothing is exploded. One row per instance."""
    w = Window.partitionBy(*tr.INSTANCE).orderBy("datetime")
    ta = F.floor(F.unix_micros("datetime") / 1_000_000)
    pair = points.select(*tr.INSTANCE, ta.alias("a"), F.lead(ta).over(w).alias("b")).filter("b is not null")
    first = F.ceil(F.col("a") / resolution_s) * resolution_s
    n = F.greatest(F.lit(0), F.ceil((F.col("b") - first) / resolution_s))
    hole = F.col("b") - F.col("a") > hole_s
    return pair.withColumn("n", n).groupBy(*tr.INSTANCE).agg(
        F.count("*").alias("pairs"),
        F.sum("n").alias("synthetic"),
        F.sum(F.when(hole, F.col("n")).otherwise(0)).alias("in_holes"),
        F.max(F.col("b") - F.col("a")).alias("longest_gap_s"),
        F.max_by("n", F.struct(F.col("b") - F.col("a"), F.col("n"))).alias("rows_in_longest"),
    )


# --- feeds and raw rows -------------------------------------------------------------------


def hourly_feed_health(logs: DataFrame) -> DataFrame:
    return logs.groupBy(F.date_trunc("hour", "fetched_at").alias("hour"), "feed_name").agg(
        F.count("*").alias("polls"),
        F.count_if("success").alias("ok"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.avg("entity_count").alias("avg_entities"),
    )


def feed_health(hourly: DataFrame) -> DataFrame:
    """Per feed: polls in total and the mean of the hourly rates."""
    return hourly.groupBy("feed_name").agg(
        F.sum("polls").alias("polls"),
        F.avg(F.col("ok") / F.col("polls")).alias("success_rate"),
        F.avg("avg_duration_ms").alias("avg_duration_ms"),
        F.avg("avg_entities").alias("avg_entities"),
    )


def snapshot_log_invariant(logs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every success has exactly one snapshot and a failure has none: count the violations."""
    snaps = snapshots.select(F.col("fetch_log_id").alias("id"), F.lit(True).alias("has_snap"))
    j = logs.select("id", "success").join(snaps, "id", "left")
    missing = F.col("has_snap").isNull()
    return j.agg(
        F.count_if("success").alias("ok_polls"),
        F.count("has_snap").alias("snaps_joined"),
        F.count_if(F.col("success") & missing).alias("ok_without_snap"),
        F.count_if(~F.col("success") & ~missing).alias("fail_with_snap"),
    )


def daily_volume_by_route(vp: DataFrame, first: Column, last: Column) -> DataFrame:
    """Rows per day and route with every day of the window present; ``zero_day`` marks days
    without any row. Long form, so the number of routes needs no limit (pivot at will)."""
    day = F.to_date("fetched_at")
    counted = vp.filter(day.between(first, last)).groupBy(day.alias("day"), "route_id").agg(F.count("*").alias("n"))
    grid = counted.select("route_id").distinct().withColumn("day", F.explode(F.sequence(first, last)))
    per_day = counted.groupBy("day").agg(F.sum("n").alias("day_rows"))
    return (
        grid.join(counted, ["day", "route_id"], "left")
        .join(per_day, "day", "left")
        .select("day", "route_id", F.coalesce("n", F.lit(0)).alias("n"), F.col("day_rows").isNull().alias("zero_day"))
    )


def field_availability(vp: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent non-null per column, one scan, unpivoted."""
    one = vp.agg(*[(100 * F.avg(F.col(c).isNotNull().cast("int"))).alias(c) for c in columns])
    return one.unpivot([], list(columns), "field", "pct_non_null")


def clock_skew_profile(vp: DataFrame) -> DataFrame:
    """Fetch time minus vehicle time in seconds. Feed times are whole seconds, so the exact
    quantiles keep one counter per distinct second."""
    skew = F.floor(F.unix_micros("fetched_at") / 1_000_000) - F.floor(F.unix_micros("vehicle_timestamp") / 1_000_000)
    return vp.select(skew.alias("s")).agg(
        F.count("s").alias("count"), F.avg("s").alias("mean"), F.stddev_samp("s").alias("std"), F.min("s").alias("min"),
        F.percentile("s", F.array(*[F.lit(p) for p in PROFILE.values()])).alias("q"), F.max("s").alias("max"),
    ).select("count", "mean", "std", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(PROFILE)], "max")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeats of a key beyond its first row, as a count and share of all rows."""
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).select("n", complete.alias("complete"))
    dup, rows = F.sum(F.when(F.col("complete"), F.col("n") - 1).otherwise(0)), F.sum("n")
    return counts.agg(dup.alias("duplicates"), (100 * dup / rows).alias("duplicate_pct"))


def vocabulary_check(df: DataFrame, column: str, vocabulary: Sequence[str]) -> DataFrame:
    """Value counts with a flag for values outside the vocabulary; null is not a violation."""
    v = F.col(column)
    return df.groupBy(F.coalesce(v, F.lit("<NULL>")).alias("value")).agg(
        F.count("*").alias("n"), F.max((v.isNotNull() & ~v.isin(list(vocabulary))).cast("int")).alias("unknown")
    )


def unknown_values(df: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    vals = df.select(F.col(column).alias("value")).filter("value is not null").distinct()
    return vals.join(vocabulary.select(F.col(vocabulary.columns[0]).alias("value")), "value", "left_anti")


def trip_update_daily(tu: DataFrame) -> DataFrame:
    return tu.groupBy(F.to_date("fetched_at").alias("day"), "feed_name").agg(
        F.count("*").alias("n"),
        F.avg(F.col("delay_seconds").isNull().cast("int")).alias("delay_null_rate"),
        F.avg("stop_time_update_count").alias("avg_stops"),
        F.avg("delay_seconds").alias("avg_delay"),
    )


def cadence_gaps(vp: DataFrame, limit_s: float = 120.0, chunk_s: int = 21600) -> DataFrame:
    """Time steps over the limit inside (vehicle, trip) and per vehicle. A vehicle's history
    has no bound, so both previous rows are found in chunks of time."""
    rows = vp.filter("vehicle_timestamp is not null").select("id", "vehicle_id", "trip_id", "vehicle_timestamp")
    chunk = F.floor(F.unix_seconds("vehicle_timestamp") / chunk_s)
    t = F.unix_micros("vehicle_timestamp")
    a = previous_in_chunks(rows, ["vehicle_id", "trip_id"], ["vehicle_timestamp", "id"], chunk, {"trip_prev": t})
    b = previous_in_chunks(a, ["vehicle_id"], ["vehicle_timestamp", "id"], chunk, {"vehicle_prev": t})
    in_trip = (t - F.col("trip_prev")) / 1e6 > limit_s
    per_vehicle = (t - F.col("vehicle_prev")) / 1e6 > limit_s
    per_trip = b.groupBy("trip_id").agg(
        F.count_if(in_trip).alias("g"), F.count_if(per_vehicle).alias("v"), F.count("*").alias("n")
    )
    return per_trip.agg(
        F.sum("g").alias("gaps_in_trip"), F.sum("v").alias("gaps_per_vehicle"),
        F.count_if((F.col("g") > 0) & F.col("trip_id").isNotNull()).alias("trips_with_gap"),
        F.count("trip_id").alias("trips"),
    )


# --- trajectories and runs ----------------------------------------------------------------


def ghost_drop_share(flagged: DataFrame) -> DataFrame:
    """From ``flag_segments`` rows: points kept and trimmed, groups lost, groups split."""
    run = ["service_date", "route_id", "direction_id", "trip_id", "start_date", "vehicle_id"]
    per = flagged.groupBy(*run).agg(
        F.count("*").alias("n"), F.count_if("kept").alias("k"),
        F.max(F.when(F.col("kept"), F.col("segment"))).alias("hi"), F.min(F.when(F.col("kept"), F.col("segment"))).alias("lo"),
        F.countDistinct(F.when(F.col("kept"), F.col("segment"))).alias("segs"),
    )
    return per.groupBy("route_id", "direction_id").agg(
        F.sum("n").alias("points"), F.sum("k").alias("kept"), F.sum(F.col("n") - F.col("k")).alias("trimmed"),
        F.count("*").alias("groups"), F.count_if(F.col("k") == 0).alias("ghosts"), F.count_if(F.col("segs") > 1).alias("split"),
    )


def resolution_by_day(kinds: DataFrame) -> DataFrame:
    """Per service date: instances by timetable resolution and the match share."""
    c = lambda k: F.count_if(F.col("kind") == k).alias(k)
    per = kinds.groupBy("start_date").agg(F.count("*").alias("n"), c("match"), c("mismatch"), c("none"))
    return per.withColumn("match_pct", F.rint(1000 * F.col("match") / F.col("n")) / 10)


def resolution_means(by_day: DataFrame, window: Column) -> DataFrame:
    """Mean match share per window name, days without instances left out."""
    return by_day.filter("n > 0").groupBy(window.alias("window")).agg(F.avg("match_pct").alias("mean_match_pct"))


def days_without_output(vp: DataFrame, traj: DataFrame) -> DataFrame:
    raw = vp.select(F.to_date("fetched_at").alias("day")).distinct()
    return raw.join(traj.select(F.col("service_date").alias("day")).distinct(), "day", "left_anti")


def daily_delivery(traj: DataFrame) -> DataFrame:
    """Rows per date, and distinct (trip, start, vehicle) per date and route."""
    keys = ["service_date", "route_id"]
    runs = traj.groupBy(*keys, "trip_id", "start_date", "vehicle_id").agg(F.count("*").alias("n"))
    per = runs.groupBy(*keys).agg(F.sum("n").alias("route_rows"), F.count("*").alias("runs"))
    day = Window.partitionBy("service_date")  # one row per route
    return per.withColumn("day_rows", F.sum("route_rows").over(day))


def roundtrip_diff(recomputed: DataFrame, stored: DataFrame, tolerance_m: float = 0.02) -> DataFrame:
    """Recomputed against stored rows on instance and time."""
    key = ["trip_id", "start_date", "datetime"]
    a = recomputed.select(*key, F.col("travel_distance_m").alias("a"))
    b = stored.select(*key, F.col("travel_distance_m").alias("b"))
    diff = F.abs(F.col("a") - F.col("b"))
    return a.join(b, key).agg(
        F.count("*").alias("matched"), F.max(diff).alias("max_diff_m"), F.count_if(diff > tolerance_m).alias("over_tolerance")
    )


def worker_heartbeat(runs: DataFrame) -> DataFrame:
    """Per day: runs, errors, rows written and p90 duration in whole seconds."""
    dur = F.unix_seconds("finished_at") - F.unix_seconds("started_at")
    return runs.groupBy(F.to_date("started_at").alias("day")).agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") != "ok").alias("errors"),
        F.sum("rows_written").alias("rows_written"), F.percentile(dur, F.lit(0.9)).alias("p90_s"),
    )


def distinct_configs(runs: DataFrame, volatile: str) -> DataFrame:
    key = values.stable_config_key(F.col("config_json"), volatile)
    return runs.groupBy(key.alias("config")).agg(F.count("*").alias("runs"))


def audit_windows(vp: DataFrame, feed_info: DataFrame, days: int = 7) -> DataFrame:
    """One row per window: the last complete days of the data, and the last days inside the
    timetable's validity, with the day of most rows (the earliest on ties)."""
    per_day = vp.groupBy(F.to_date("fetched_at").alias("day")).agg(F.count("*").alias("n"))
    extent = per_day.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    valid = feed_info.select(F.to_date("feed_end_date", "yyyyMMdd").alias("until"), "feed_start_date", "feed_end_date").limit(1)
    both = extent.withColumn("_k", F.lit(1)).join(valid.withColumn("_k", F.lit(1)), "_k", "left")  # one row each
    last = F.date_sub("hi", 1)
    ctl = F.least(F.coalesce("until", last), last)
    windows = both.select("feed_start_date", "feed_end_date", F.explode(F.array(
        F.struct(F.lit("audit").alias("window"), F.date_sub("hi", days).alias("first"), last.alias("last")),
        F.struct(F.lit("control").alias("window"), F.greatest(F.date_sub(ctl, days - 1), F.col("lo")).alias("first"), ctl.alias("last")),
    )).alias("w")).select("feed_start_date", "feed_end_date", "w.*")
    each = windows.withColumn("day", F.explode(F.sequence("first", "last"))).join(per_day, "day", "left")
    ymd = F.date_format("day", "yyyyMMdd")
    covered = F.coalesce((F.col("feed_start_date") <= ymd) & (ymd <= F.col("feed_end_date")), F.lit(True))
    return each.groupBy("window", "first", "last").agg(
        F.min_by("day", F.struct(-F.coalesce("n", F.lit(0)), F.col("day"))).alias("richest_day"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(covered).alias("covered_days"),
    )
