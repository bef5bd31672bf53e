"""Idle, crowding and bunching detectors over bus points of many slices at once.

Events share one layout: slice, ``bus_id``, ``minute_of_day``, ``stop_index``, ``type``,
``method``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..defaults import DEFAULTS
from ..functions import times, values
from ..session import cut, materialise, tasks_for
from .buses import SLICE

BUS = [*SLICE, "bus_id"]
EVENT = [*BUS, "minute_of_day", "stop_index", "type", "method"]


def _mid_event(runs: DataFrame, kind: str, method: str | None) -> DataFrame:
    """Event at the time and stop midpoint of a run given ``t0_us, t1_us, s0, s1``."""
    mid = F.expr("(t0_us + t1_us) div 2000000")
    return runs.select(
        *BUS,
        times.local_minute(F.timestamp_seconds(mid)).alias("minute_of_day"),
        ((F.col("s0") + F.col("s1")) / 2.0).alias("stop_index"),
        F.lit(kind).alias("type"),
        F.lit(method).cast("string").alias("method"),
    )


def _runs(points: DataFrame, flag: Column) -> DataFrame:
    """Maximal stretches of flagged points per bus: the count of unflagged points so far names
    the stretch, and the grouping key extends the window key, so nothing moves twice."""
    w = Window.partitionBy(*BUS).orderBy("datetime")
    marked = points.withColumn("_on", F.coalesce(flag, F.lit(False))).withColumn(
        "_run", F.sum((~F.col("_on")).cast("int")).over(w)
    )
    us = F.unix_micros("datetime")
    return (
        marked.filter("_on")
        .groupBy(*BUS, "_run")
        .agg(
            F.min(us).alias("t0_us"),
            F.max(us).alias("t1_us"),
            F.min_by("stop_index", us).alias("s0"),
            F.max_by("stop_index", us).alias("s1"),
        )
    )


def idle_events(points: DataFrame, idle_minutes: float = DEFAULTS.idle_minutes) -> DataFrame:
    """Signed speed below the limit for at least the given minutes (null counts as zero)."""
    slow = F.coalesce("moving_speed_m_s", F.lit(0.0)) < DEFAULTS.idle_speed_m_s
    runs = _runs(points, slow).filter((F.col("t1_us") - F.col("t0_us")) / 1e6 >= idle_minutes * 60.0)
    return _mid_event(runs, "idle", None)


def is_crowded(crowd_pct: float) -> Column:
    pct = values.occupancy_pct(F.col("occupancy_status"))
    return (pct >= crowd_pct) & (pct >= 0)


def crowd_events(points: DataFrame, crowd_pct: float = DEFAULTS.crowd_pct) -> DataFrame:
    return _mid_event(_runs(points, is_crowded(crowd_pct)), "crowd", None)


def stop_crossings(points: DataFrame) -> DataFrame:
    """First interpolated passage of each whole stop index per bus, in either direction of
    travel; the earliest pair that spans a stop decides."""
    w = Window.partitionBy(*BUS).orderBy("datetime")
    pair = points.select(
        *BUS,
        F.unix_micros("datetime").alias("ta"),
        F.col("stop_index").alias("sa"),
        F.lead(F.unix_micros("datetime")).over(w).alias("tb"),
        F.lead("stop_index").over(w).alias("sb"),
    ).filter("tb is not null")
    up = F.col("sa") <= F.col("sb")
    pair = pair.select(
        *BUS,
        "ta",
        F.when(up, F.col("ta")).otherwise(F.col("tb")).alias("t_lo"),
        F.when(up, F.col("tb")).otherwise(F.col("ta")).alias("t_hi"),
        F.least("sa", "sb").alias("s_lo"),
        F.greatest("sa", "sb").alias("s_hi"),
        up.alias("upward"),
    )
    spanned = pair.withColumns({"k0": F.ceil("s_lo"), "k1": F.floor("s_hi")}).filter("k0 <= k1")
    each = spanned.withColumn("stop", F.explode(F.sequence("k0", "k1")))
    frac = (F.col("stop") - F.col("s_lo")) / (F.col("s_hi") - F.col("s_lo"))
    at = F.when(F.col("s_hi") <= F.col("s_lo"), F.col("t_lo")).otherwise(
        F.col("t_lo") + F.rint(frac * (F.col("t_hi") - F.col("t_lo"))).cast("bigint")
    )
    return each.groupBy(*BUS, "stop").agg(
        F.min_by(F.struct(at.alias("cross_us"), F.col("upward")), "ta").alias("_c")
    ).select(*BUS, "stop", "_c.cross_us", "_c.upward")


def bunch_time_events(crossings: DataFrame, bunch_seconds: float = DEFAULTS.bunch_seconds) -> DataFrame:
    """Consecutive passages of one stop closer than the limit; the later bus is tagged. The
    window holds one passage per bus of a slice and stop."""
    w = Window.partitionBy(*SLICE, "stop").orderBy("cross_us", "bus_id")
    gap = (F.col("cross_us") - F.lag("cross_us").over(w)) / 1e6
    return (
        crossings.withColumn("_gap", gap)
        .filter((F.col("_gap") > 0) & (F.col("_gap") < bunch_seconds))
        .select(
            *BUS,
            times.local_minute(F.timestamp_micros("cross_us")).alias("minute_of_day"),
            F.col("stop").cast("double").alias("stop_index"),
            F.lit("bunch").alias("type"),
            F.lit("time").alias("method"),
        )
    )


def interpolate_on_ticks(
    points: DataFrame, tick_s: float = DEFAULTS.tick_s, max_gap_s: float | None = None
) -> DataFrame:
    """Distance and stop index of every bus at each tick of its slice's clock.

    The clock starts at the slice's first point. Each tick belongs to the pair ``(earlier,
    later]`` of points around it, so the search is a sequence per pair. Buses with a single
    point take no part. ``max_gap_s`` leaves holes unfilled where points are further apart.
    """
    w = Window.partitionBy(*BUS).orderBy("datetime")
    pair = points.select(
        *BUS,
        F.unix_micros("datetime").alias("tb"),
        F.col("travel_distance_m").alias("db"),
        F.col("stop_index").alias("sb"),
        F.lag(F.struct(F.unix_micros("datetime").alias("t"), F.col("travel_distance_m").alias("d"),
                       F.col("stop_index").alias("s"))).over(w).alias("a"),
        F.count("*").over(Window.partitionBy(*BUS)).alias("n"),
    ).filter("n >= 2")
    per_bus = points.groupBy(*BUS).agg(F.min(F.unix_micros("datetime")).alias("t"), F.count("*").alias("n"))
    start = per_bus.filter("n >= 2").groupBy(*SLICE).agg(F.min("t").alias("t_min"))
    step = int(round(tick_s * 1_000_000))
    timed = pair.join(start, SLICE)
    lo = F.when(F.col("a").isNull(), F.ceil((F.col("tb") - F.col("t_min")) / step)).otherwise(
        F.floor((F.col("a.t") - F.col("t_min")) / step) + 1
    )
    timed = timed.withColumns({"k0": lo, "k1": F.floor((F.col("tb") - F.col("t_min")) / step)})
    if max_gap_s is not None:
        timed = timed.filter(F.col("a").isNull() | ((F.col("tb") - F.col("a.t")) / 1e6 <= max_gap_s))
    ticks = timed.filter("k0 <= k1").withColumn("tick", F.explode(F.sequence("k0", "k1")))
    t = F.col("t_min") + F.col("tick") * step
    frac = (t - F.col("a.t")) / (F.col("tb") - F.col("a.t"))
    return ticks.select(
        *BUS,
        "tick",
        t.alias("t_us"),
        F.when(F.col("a").isNull(), F.col("db"))
        .otherwise(F.col("a.d") + frac * (F.col("db") - F.col("a.d")))
        .alias("dist_m"),
        F.when(F.col("a").isNull(), F.col("sb"))
        .otherwise(F.col("a.s") + frac * (F.col("sb") - F.col("a.s")))
        .alias("stop_index"),
    )


def adjacent_pairs(ticks: DataFrame) -> DataFrame:
    """At each tick, every bus with the next one ahead by distance (one window per tick). The ticks are many times the
    points they lie between, so they are stored, counted and cut by their own number."""
    stored = materialise(ticks, "ticks")
    w = Window.partitionBy(*SLICE, "tick").orderBy("dist_m", "bus_id")
    return cut(stored, tasks_for(stored), *SLICE, "tick").withColumns(
        {"leader_id": F.lead("bus_id").over(w), "gap_m": F.lead("dist_m").over(w) - F.col("dist_m")}
    ).filter("leader_id is not null")


def bunch_distance_runs(
    ticks: DataFrame,
    enter_m: float = DEFAULTS.bunch_distance_m,
    exit_m: float | None = None,
    min_duration_s: float = 0.0,
) -> DataFrame:
    """Runs of the same adjacent pair staying close, with the follower's stops at both ends.

    The exit limit is never below the enter limit, so an island of ticks below the exit limit
    holds at most one run: from its first tick below the enter limit to its end. That needs
    islands and a minimum, no state machine.
    """
    leave = enter_m if exit_m is None else max(exit_m, enter_m)
    close = adjacent_pairs(ticks).filter((F.col("gap_m") > 0) & (F.col("gap_m") < leave))
    pair = [*BUS, "leader_id"]
    w = Window.partitionBy(*pair).orderBy("tick")
    islands = close.withColumn("_island", F.col("tick") - F.row_number().over(w))
    enters = F.when(F.col("gap_m") < enter_m, F.struct("tick", "t_us", "stop_index"))
    return (
        islands.groupBy(*pair, "_island")
        .agg(F.min(enters).alias("a"), F.max(F.struct("tick", "t_us", "stop_index")).alias("b"))
        .filter("a is not null")
        .select(*pair, F.col("a.t_us").alias("t0_us"), F.col("b.t_us").alias("t1_us"),
                F.col("a.stop_index").alias("s0"), F.col("b.stop_index").alias("s1"))
        .filter((F.col("t1_us") - F.col("t0_us")) / 1e6 >= min_duration_s)
    )


def bunch_distance_events(ticks: DataFrame, *limits: float | None) -> DataFrame:
    """One event per close run, at its middle, on the follower."""
    return _mid_event(bunch_distance_runs(ticks, *limits), "bunch", "distance")


def detect_all(
    points: DataFrame,
    bunch_seconds: float = DEFAULTS.bunch_seconds,
    idle_minutes: float = DEFAULTS.idle_minutes,
    crowd_pct: float = DEFAULTS.crowd_pct,
    bunch_distance_m: float = DEFAULTS.bunch_distance_m,
    method: str = "time",
    exit_m: float | None = None,
    min_duration_s: float = 0.0,
    tick_s: float = DEFAULTS.tick_s,
) -> DataFrame:
    """Union of the detectors; ``method`` is ``time``, ``distance`` or ``both``."""
    if method not in ("time", "distance", "both"):
        raise ValueError(f"unknown bunch method {method!r}")
    found = [idle_events(points, idle_minutes), crowd_events(points, crowd_pct)]
    if method in ("time", "both"):
        found.append(bunch_time_events(stop_crossings(points), bunch_seconds))
    if method in ("distance", "both"):
        found.append(
            bunch_distance_events(interpolate_on_ticks(points, tick_s), bunch_distance_m, exit_m, min_duration_s)
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(*EVENT)
