"""Grid tracks, leaders, and labelled windows for short-horizon bunching forecasts.

Everything is keyed by slice and bus. A tick window holds the buses of one slice at one
instant; a bus window holds one bus's ticks of one service day. Ticks are whole numbers
``(time - anchor) / step``, so contiguity is arithmetic on integers and frames are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..defaults import DEFAULTS, NO_LEADER_GAP_M
from ..functions import times
from ..session import cut, materialise, tasks_for
from .buses import SLICE
from .detect import BUS

IDENTITY = ["trip_id", "start_date", "vehicle_id"]
TICK = [*SLICE, "k"]
GRID_ROWS_PER_TASK = 50_000  # rows with their windows and labels, about


def _anchored(points: DataFrame, anchor: str | None) -> Column:
    base = F.unix_micros("datetime")
    return base if anchor is None else base - F.col(anchor).cast("bigint") * 1_000_000


def grid_track(
    points: DataFrame,
    step_s: int = DEFAULTS.step_s,
    max_gap_s: float | None = None,
    sampling: str = "linear",
    anchor: str | None = None,
) -> DataFrame:
    """Bus positions on a regular grid; rows exist only for valid ticks.

    ``linear`` interpolates between the samples around a tick and needs the nearer one within
    ``max_gap_s`` (twice the step by default). ``nearest`` takes the nearest sample within that
    distance, the earlier on ties, also just outside the bus's span. The grid is aligned to the
    epoch, or to the epoch seconds in column ``anchor``.
    """
    limit = int(round((2 * step_s if max_gap_s is None else max_gap_s) * 1_000_000))
    step = step_s * 1_000_000
    keep = [c for c in ("num_stops", "shape_length_m") if c in points.columns]
    keep += [anchor] if anchor else []
    w = Window.partitionBy(*BUS, *([anchor] if anchor else [])).orderBy("datetime")
    sample = F.struct(
        F.col("t").alias("t"), F.col("travel_distance_m").alias("d"), F.col("moving_speed_m_s").alias("v"), F.col("stop_index").alias("s")
    )
    base = points.withColumn("t", _anchored(points, anchor))
    out = [*BUS, *IDENTITY, *keep]
    if sampling == "nearest":
        near = base.withColumns({"prev_t": F.lag("t").over(w), "next_t": F.lead("t").over(w)})
        after_mid = F.floor((F.col("prev_t") + F.col("t")) / 2 / step) + 1
        lo = F.greatest(F.ceil((F.col("t") - limit) / step), F.coalesce(after_mid, F.ceil((F.col("t") - limit) / step)))
        till_mid = F.floor((F.col("t") + F.col("next_t")) / 2 / step)
        hi = F.least(F.floor((F.col("t") + limit) / step), F.coalesce(till_mid, F.floor((F.col("t") + limit) / step)))
        rows = near.withColumns({"k0": lo, "k1": hi}).filter("k0 <= k1")
        return rows.select(
            *out, F.explode(F.sequence("k0", "k1")).alias("k"), F.col("travel_distance_m").alias("dist_m"),
            F.col("moving_speed_m_s").alias("speed"), "stop_index",
        )
    if sampling != "linear":
        raise ValueError(f"unknown sampling {sampling!r}")
    pair = base.select(*out, sample.alias("b"), F.lag(sample).over(w).alias("a"))
    lo = F.when(F.col("a").isNull(), F.ceil(F.col("b.t") / step)).otherwise(F.floor(F.col("a.t") / step) + 1)
    rows = (
        pair.withColumns({"k0": lo, "k1": F.floor(F.col("b.t") / step)})
        .filter("k0 <= k1")
        .withColumn("k", F.explode(F.sequence("k0", "k1")))
        .withColumn("tk", F.col("k") * step)
    )
    from_a, to_b = F.col("tk") - F.col("a.t"), F.col("b.t") - F.col("tk")
    alone = F.col("a").isNull()
    frac = from_a / (F.col("b.t") - F.col("a.t"))
    # a tick at a sample takes the sample's own value: a + 1 * (b - a) can miss b by its last bit
    line = lambda f: F.when(alone | (to_b == 0), F.col(f"b.{f}")).otherwise(
        F.col(f"a.{f}") + frac * (F.col(f"b.{f}") - F.col(f"a.{f}")))
    nearer_v = F.when(from_a <= to_b, F.col("a.v")).otherwise(F.col("b.v"))
    both = F.col("a.v").isNotNull() & F.col("b.v").isNotNull()
    valid = alone | (F.least(from_a, to_b) <= limit)
    speed = F.when(alone, F.col("b.v")).when(both, line("v")).otherwise(nearer_v)
    return rows.filter(valid).select(
        *out, "k", line("d").alias("dist_m"), speed.alias("speed"), line("s").alias("stop_index")
    )


def leader_chain(grid: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """At each tick: nearest bus strictly ahead and the two ahead of it, with speeds and gaps.

    Rows of a tick are sorted from the front of the route backwards, the lowest bus last among
    equal distances. Only that last row of a distance is seen by those behind, so the last
    non-null value before the current row is the nearest strictly larger distance. Each level
    carries the level before along; there is no self-join. Missing links get speed 0 and the
    no-leader gap.
    """
    w = Window.partitionBy(*SLICE, *extra_keys, "k").orderBy(F.desc("dist_m"), F.desc("bus_id"))
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    closes = F.lead("dist_m").over(w).isNull() | (F.lead("dist_m").over(w) < F.col("dist_m"))
    g = grid.withColumn("_seen", closes)
    me = F.struct(F.col("dist_m").alias("d"), F.coalesce("speed", F.lit(0.0)).alias("v"), F.col("bus_id").alias("id"))
    g = g.withColumn("_l1", F.last(F.when(F.col("_seen"), me), ignorenulls=True).over(so_far))
    g = g.withColumn("_l2", F.last(F.when(F.col("_seen"), F.struct("_l1")), ignorenulls=True).over(so_far)["_l1"])
    g = g.withColumn("_l3", F.last(F.when(F.col("_seen"), F.struct("_l2")), ignorenulls=True).over(so_far)["_l2"])
    none = F.lit(NO_LEADER_GAP_M)
    return g.withColumns(
        {
            "fwd_gap_m": F.coalesce(F.col("_l1.d") - F.col("dist_m"), none),
            "d1_speed": F.coalesce("_l1.v", F.lit(0.0)),
            "d1_gap_m": F.coalesce(F.col("_l2.d") - F.col("_l1.d"), none),
            "d2_speed": F.coalesce("_l2.v", F.lit(0.0)),
            "d2_gap_m": F.coalesce(F.col("_l3.d") - F.col("_l2.d"), none),
            "leader_id": F.col("_l1.id"),
        }
    ).drop("_seen", "_l1", "_l2", "_l3")


def follower_pair(grid: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """At each tick the two nearest buses strictly behind (lower bus first among equals)."""
    tick = [*SLICE, *extra_keys, "k"]
    w = Window.partitionBy(*tick).orderBy("dist_m", F.desc("bus_id"))
    me = F.struct(F.col("dist_m").alias("d"), F.coalesce("speed", F.lit(0.0)).alias("v"))
    # the row before the first of a distance is the nearest strictly behind for all of them
    same = Window.partitionBy(*tick, "dist_m").orderBy(F.desc("bus_id"))
    g = grid.withColumns({"_p1": F.lag(me, 1).over(w), "_p2": F.lag(me, 2).over(w)})
    g = g.withColumn("_b", F.first(F.struct("_p1", "_p2")).over(same))
    none = F.lit(NO_LEADER_GAP_M)
    out = {}
    for i in (1, 2):
        out[f"u{i}_speed"] = F.coalesce(f"_b._p{i}.v", F.lit(0.0))
        out[f"u{i}_gap_m"] = F.coalesce(F.col("dist_m") - F.col(f"_b._p{i}.d"), none)
    return g.withColumns(out).drop("_p1", "_p2", "_b")


def passage_headway(chain: DataFrame, step_s: int = DEFAULTS.step_s, tasks: int | None = None) -> DataFrame:
    """Realised headway at each tick: time since the leader first reached my distance.

    A bus's track (running maximum of distance) and the questions its followers ask of it are
    put on one line of distances; the track points on either side of a question come from two
    running ``last`` values. Null where the leader's track does not span the distance. ``tasks``: how many take the line.
    """
    by_time = Window.partitionBy(*BUS).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = chain.withColumns(
        {"_cm": F.max("dist_m").over(by_time), "_n": F.count("*").over(Window.partitionBy(*BUS))}
    )
    # every row goes out twice: as a point of its own track, and as a question to its leader
    none = F.lit(None)
    row = F.struct(*[F.col(c) for c in chain.columns])
    track = F.struct(F.col("bus_id").alias("on_bus"), F.col("_cm").alias("d"), F.lit(0).alias("ask"),
                     F.struct(F.col("_cm").alias("d"), F.col("k").alias("k"), F.col("_n").alias("n")).alias("point"), F.when(F.lit(False), row).alias("row"))
    ask = F.struct(F.coalesce("leader_id", "bus_id").alias("on_bus"), F.col("dist_m").alias("d"), F.lit(1).alias("ask"),
                   none.cast("struct<d: double, k: bigint, n: bigint>").alias("point"), row.alias("row"))
    line = rows.select(*SLICE, "k", F.explode(F.array(track, ask)).alias("z")).select(
        *[F.col(c).alias(f"_{c}") for c in SLICE], F.col("k").alias("_k"), "z.*")
    keys = [f"_{c}" for c in SLICE] + ["on_bus"]
    line = line if tasks is None else cut(line, tasks, *keys)
    up = Window.partitionBy(*keys).orderBy("d", F.desc("ask"), "_k").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc("d"), "ask", F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    placed = line.withColumns(
        {"below": F.last("point", ignorenulls=True).over(up), "above": F.last("point", ignorenulls=True).over(down)}
    ).filter("ask = 1")
    t = F.when(F.col("below").isNull(), F.when(F.col("above.d") == F.col("d"), F.col("above.k").cast("double"))).otherwise(
        F.col("below.k") + (F.col("d") - F.col("below.d")) / (F.col("above.d") - F.col("below.d")) * (F.col("above.k") - F.col("below.k"))
    )
    known = F.col("row.leader_id").isNotNull() & (F.col("above.n") >= 2)
    return placed.select("row.*", F.when(known, (F.col("_k") - t) * step_s).alias("headway_s"))


# Channel names of the history window and of the context layouts.
CHANNELS = {
    1: ("target_speed", "target_gap", "target_aux", "u1_speed", "u1_gap", "u1_aux", "u2_speed", "u2_gap", "u2_aux"),
    2: ("target_speed", "target_fwd_gap", "d1_speed", "d1_fwd_gap", "d2_speed", "d2_fwd_gap"),
}
CONTEXT = {
    1: ("stop_index", "stop_index_norm", "gap_closure_m_per_s", "leader_speed", "dwell_recent_s", "tod_sin", "tod_cos"),
    2: ("stop_index", "stop_index_norm", "gap_closure_m_per_s", "leader_speed", "dwell_recent_s", "tod_sin", "tod_cos",
        "dist_to_terminus_m", "dist_to_terminus_norm", "time_to_terminus_min"),
    3: ("stop_index", "stop_index_norm", "gap_closure_m_per_s", "dwell_recent_s", "tod_sin", "tod_cos", "dist_to_terminus_norm"),
    4: ("stop_index_norm", "gap_closure_m_per_s", "tod_sin", "tod_cos", "rel_speed_to_d1", "target_accel_3tick"),
}


def with_ticks(chain: DataFrame, length: int = DEFAULTS.history_ticks, step_s: int = DEFAULTS.step_s, layout: int = 4,
               anchor: str | None = None) -> DataFrame:
    """``chain`` with ``_tick``, all that a window shows of a tick, worked out once per tick.

    What looks back depends on the tick's place in its window only through how far it may look, a few steps. So a tick
    carries one value for each reach: gap closure by lags, dwell by differences of a running count, the median speed over
    its last few readings. A window then picks by place; nothing is computed anew for each window that shows the tick.
    """
    w = Window.partitionBy(*BUS, *([anchor] if anchor else [])).orderBy("k")
    at = F.col("k") * step_s + (F.col(anchor).cast("bigint") if anchor else F.lit(0))
    minute = times.local_minute(F.timestamp_seconds(at))
    wanted = CONTEXT[layout]
    back, dwell_ticks = _reaches(length, step_s)
    line = F.col("shape_length_m") if layout in (2, 3) and "shape_length_m" in chain.columns else F.lit(None).cast("double")
    has_line = line.isNotNull() & (line > 0)
    left = F.greatest(F.lit(0.0), line - F.col("dist_m"))
    lagged = {f"_g{i}": F.lag("fwd_gap_m", i).over(w) for i in range(1, back + 1)}
    if "target_accel_3tick" in wanted:
        lagged["_v3"] = F.lag("_v", 3).over(w)
    if "dwell_recent_s" in wanted:
        lagged["_slow"] = F.sum((F.coalesce(F.col("speed") < 0.5, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if "time_to_terminus_min" in wanted:
        lagged |= {f"_r{i}": F.lag("speed", i).over(w) for i in range(1, dwell_ticks)}
    rows = chain.withColumn("_v", F.coalesce("speed", F.lit(0.0))).withColumns(lagged)
    if "_slow" in lagged:
        rows = rows.withColumns({f"_s{i}": F.coalesce(F.lag("_slow", i).over(w), F.lit(0)) for i in range(1, dwell_ticks + 1)})

    def closing(i: int) -> Column:
        known = (F.col(f"_g{i}") < NO_LEADER_GAP_M) & (F.col("fwd_gap_m") < NO_LEADER_GAP_M)
        return F.when(known, (F.col(f"_g{i}") - F.col("fwd_gap_m")) / (i * step_s)).otherwise(0.0)

    def terminus(n: int) -> Column:
        recent = F.filter(F.array("speed", *[f"_r{i}" for i in range(1, n)]), lambda v: v.isNotNull())
        moving = F.filter(recent, lambda v: v >= 0.5)
        base = F.array_sort(F.when(F.size(moving) > 0, moving).otherwise(recent))
        m = F.size(base)
        median = F.when(m > 0, (F.get(base, ((m - 1) / 2).cast("int")) + F.get(base, (m / 2).cast("int"))) / 2).otherwise(0.0)
        return F.when(has_line, left / F.greatest(median, F.lit(1.0)) / 60.0).otherwise(0.0)

    context = {
        "stop_index": lambda: F.col("stop_index"),
        "stop_index_norm": lambda: F.when(F.col("num_stops") > 0, F.col("stop_index") / F.col("num_stops")).otherwise(0.0),
        "gap_closure_m_per_s": lambda: F.array(*[closing(i) for i in range(1, back + 1)]),
        "dwell_recent_s": lambda: F.array(*[(F.col("_slow") - F.col(f"_s{n}")) * float(step_s) for n in range(1, dwell_ticks + 1)]),
        "tod_sin": lambda: times.tod_sin(minute), "tod_cos": lambda: times.tod_cos(minute),
        "dist_to_terminus_m": lambda: F.when(has_line, left).otherwise(0.0),
        "dist_to_terminus_norm": lambda: F.when(has_line, left / line).otherwise(0.0),
        "time_to_terminus_min": lambda: F.array(*[terminus(n) for n in range(1, dwell_ticks + 1)]),
        "rel_speed_to_d1": lambda: F.when(F.col("d1_speed") != 0, F.col("_v") - F.col("d1_speed")).otherwise(0.0),
        "target_accel_3tick": lambda: F.coalesce((F.col("_v") - F.col("_v3")) / (3.0 * step_s), F.lit(0.0)),
    }
    ups = [F.col(f"u{i}_{f}") for i in (1, 2) for f in ("speed", "gap_m")] if "u1_speed" in chain.columns else []
    tick = F.struct(
        F.col("k").alias("k"), F.col("_v").alias("v"), F.col("fwd_gap_m").alias("gap"), F.col("d1_speed").alias("d1v"), F.col("d1_gap_m").alias("d1g"),
        F.col("d2_speed").alias("d2v"), F.col("d2_gap_m").alias("d2g"), *[context[n]().alias(n) for n in wanted if n in context], *ups)
    return rows.select(*chain.columns, tick.alias("_tick"))


def _reaches(length: int, step_s: int) -> tuple[int, int]:
    """Ticks that gap closure looks back, and that dwell and the median speed take in."""
    return max(1, min(3, length - 1)), max(1, round(300 / step_s))


def history_window(
    chain: DataFrame,
    length: int = DEFAULTS.history_ticks,
    step_s: int = DEFAULTS.step_s,
    edge: int = DEFAULTS.edge_stops,
    channels: int = 2,
    band: str = "exact",
    anchor: str | None = None,
    layout: int = 4,
) -> DataFrame:
    """Ticks with a full, unbroken history inside the stop band and at least one neighbour in
    it (a leader for layout 2, a follower for layout 1). Adds ``hist``, the ordered ticks with
    what context ``layout`` needs of them."""
    w = Window.partitionBy(*BUS, *([anchor] if anchor else [])).orderBy("k").rangeBetween(-(length - 1), 0)
    stop = F.col("stop_index") if band == "exact" else F.rint("stop_index")
    inside = (stop >= edge) & (stop < F.col("num_stops") - edge)
    near = F.col("fwd_gap_m") < NO_LEADER_GAP_M if channels == 2 else (F.col("u1_gap_m") < NO_LEADER_GAP_M) | (F.col("u2_gap_m") < NO_LEADER_GAP_M)
    rows = with_ticks(chain, length, step_s, layout, anchor).withColumn("_near", near)
    rows = rows.withColumns({"_n": F.count("*").over(w), "_some": F.max("_near").over(w), "hist": F.collect_list("_tick").over(w)})
    return rows.filter((F.col("_n") == length) & inside & F.col("_some")).drop("_n", "_near", "_some", "_tick")


def window_channels(hist: Column, layout: int = 2) -> Column:
    zero = F.lit(0.0)
    if layout == 2:
        return F.transform(hist, lambda x: F.array(x["v"], x["gap"], x["d1v"], x["d1g"], x["d2v"], x["d2g"]))
    return F.transform(hist, lambda x: F.array(
        x["v"], x["gap"], zero, x["u1_speed"], x["u1_gap_m"], zero, x["u2_speed"], x["u2_gap_m"], zero))


def context_features(layout: int = 4, length: int = DEFAULTS.history_ticks, step_s: int = DEFAULTS.step_s) -> Column:
    """Context channels per tick of ``hist``. Looking back stops at the start of the window: a tick's place there picks
    the value of that reach."""
    back, dwell_ticks = _reaches(length, step_s)

    def each(x: Column, i: Column) -> Column:
        recent = F.least(i, F.lit(dwell_ticks - 1))
        picked = {
            "gap_closure_m_per_s": F.when(i > 0, F.get(x["gap_closure_m_per_s"], F.least(F.lit(back), i) - 1)).otherwise(0.0),
            "leader_speed": x["d1v"],
            "dwell_recent_s": F.get(x["dwell_recent_s"], recent),
            "time_to_terminus_min": F.get(x["time_to_terminus_min"], recent),
            "target_accel_3tick": F.when(i >= 3, x["target_accel_3tick"]).otherwise(0.0),
        }
        return F.array(*[picked.get(name, x[name]).cast("double") for name in CONTEXT[layout]])

    return F.transform("hist", each)


def horizon_labels(
    chain: DataFrame,
    horizon: int = DEFAULTS.horizon_ticks,
    gap_m: float = DEFAULTS.label_gap_m,
    edge: int = DEFAULTS.edge_stops,
    persist: int = DEFAULTS.persist_ticks,
    terminal_mask: bool = True,
    on_hole: str = "stop",
) -> DataFrame:
    """Arrays of length ``horizon``: bunched or not at +1..+H, the gap, the debounced label and
    the headway. A missing tick ends the walk (or, with ``skip``, only its own entry); a tick
    in the terminal band is null but the walk goes on. The debounced label needs the gap below
    the limit for ``persist`` valid ticks in a row and falls back to the plain one."""
    by_bus = Window.partitionBy(*BUS).orderBy("k")
    held_over = by_bus.rangeBetween(-(persist - 1), 0)
    close = (F.col("fwd_gap_m") < gap_m).cast("double")
    held = F.when(F.count("*").over(held_over) == persist, F.min(close).over(held_over))
    in_band = (F.col("stop_index") >= edge) & (F.col("stop_index") < F.col("num_stops") - edge)
    ahead = by_bus.rangeBetween(1, horizon)
    entry = F.struct(
        (F.col("k")).alias("k"), F.when(F.lit(not terminal_mask) | in_band, F.struct(
            close.alias("y"), F.col("fwd_gap_m").alias("g"), F.coalesce(F.col("_held"), close).alias("p"), F.col("headway_s").alias("h"))).alias("e"))
    rows = chain.withColumn("_held", held).withColumn("_fut", F.collect_list(entry).over(ahead))
    offset = lambda x: x["k"] - F.col("k")
    ticks = F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))
    if on_hole == "skip":
        usable = F.map_from_entries(F.transform("_fut", lambda x: F.struct(offset(x).cast("long"), x["e"])))
        at = lambda f: F.transform(ticks, lambda h: F.try_element_at("_use", h)[f])
    else:  # what is left is an unbroken run from +1: the entry of +h stands at h - 1
        usable = F.filter("_fut", lambda x, i: offset(x) == i + 1)
        at = lambda f: F.transform(ticks, lambda h: F.get("_use", (h - 1).cast("int"))["e"][f])
    return rows.withColumn("_use", usable).withColumns(
        {"labels": at("y"), "label_gaps": at("g"), "labels_persist": at("p"), "labels_headway_s": at("h")}
    ).drop("_fut", "_use", "_held")


def labelled_examples(
    points: DataFrame,
    length: int = DEFAULTS.history_ticks,
    horizon: int = DEFAULTS.horizon_ticks,
    step_s: int = DEFAULTS.step_s,
    layout: int = 4,
    channels: int = 2,
    sampling: str = "linear",
    headways: DataFrame | None = None,
    **label_options,
) -> DataFrame:
    """Windows, context and labels for every bus and valid reference tick of every slice. The grid is stored and counted, so
    that a task of any later step holds the same number of its rows however many there are."""
    grid = materialise(grid_track(points, step_s, sampling=sampling), "grid")
    n = tasks_for(grid, GRID_ROWS_PER_TASK)
    chain = leader_chain(cut(grid, n, *TICK))
    if channels == 1:
        chain = follower_pair(chain)
    # each row goes out twice to be timed
    timed = passage_headway(cut(chain, n, *BUS), step_s, None if n is None else 2 * n)
    labelled = horizon_labels(cut(timed, n, *BUS), horizon, **label_options)
    rows = history_window(labelled, length, step_s, channels=channels, layout=layout)
    out = rows.select(
        *BUS, *IDENTITY, "k",
        times.local_minute(F.timestamp_seconds(F.col("k") * step_s)).alias("t_ref_min"),
        F.col("stop_index").alias("stop_idx_at_ref"), F.col("fwd_gap_m").alias("forward_gap_at_ref"),
        window_channels(F.col("hist"), channels).alias("window"),
        context_features(layout, length, step_s).alias("extras"),
        "labels", "label_gaps", "labels_persist", "labels_headway_s", F.col("headway_s").alias("headway_at_ref_s"),
    )
    out = out.withColumn("example_id", F.concat_ws("|", *SLICE, "bus_id", "k"))
    if headways is None:
        return out.withColumn("sched_headway_s", F.lit(None).cast("double"))
    return out.join(headways.select(*SLICE, "trip_id", "sched_headway_s"), [*SLICE, "trip_id"], "left")


def headway_ratio_labels(headway: Column, scheduled: Column, ratio: float = DEFAULTS.headway_ratio) -> Column:
    """Per horizon: bunched if the realised headway is at most the ratio of the scheduled one."""
    return F.transform(headway, lambda h: F.when(h.isNotNull() & scheduled.isNotNull(), (h <= ratio * scheduled).cast("double")))


def label_profile(examples: DataFrame) -> DataFrame:
    """Per horizon: positive and missing rates, missing inside and at the end of the walk, and
    positives before and after debouncing."""
    n = F.size("labels")
    last = F.greatest(F.lit(0), F.array_max(F.transform("labels", lambda y, i: F.when(y.isNotNull(), i + 1).otherwise(0))))
    each = examples.select(
        last.alias("last"), F.posexplode(F.arrays_zip("labels", "labels_persist")).alias("h", "z")
    ).select((F.col("h") + 1).alias("h"), "last", F.col("z.labels").alias("y"), F.col("z.labels_persist").alias("p"))
    gone = F.col("y").isNull()
    return each.groupBy("h").agg(
        F.count("*").alias("n"), F.avg("y").alias("positive_rate"), F.avg(gone.cast("int")).alias("missing_rate"),
        F.count_if(gone & (F.col("h") < F.col("last"))).alias("interior_missing"),
        F.count_if(gone & (F.col("h") > F.col("last"))).alias("trailing_missing"),
        F.sum("y").alias("positives"), F.sum("p").alias("positives_debounced"),
    )


def window_pairs_correlation(examples: DataFrame, channel_names: tuple[str, ...]) -> DataFrame:
    """Pearson correlation of every channel pair per tick, averaged over ticks (an undefined one
    counts as zero). All moments are sums in one aggregate per tick."""
    n = len(channel_names)
    rows = examples.select(F.posexplode(F.zip_with("window", "extras", lambda a, b: F.concat(a, b))).alias("tick", "x"))
    chan = rows.select("tick", *[F.col("x")[i].alias(f"x{i}") for i in range(n)])
    moments = [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(n) for j in range(i + 1, n)]
    spread = [F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(n)]
    per_tick = chan.groupBy("tick").agg(*moments, *spread).select(
        *[F.try_divide(F.col(f"c{i}_{j}"), F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}_{j}") for i in range(n) for j in range(i + 1, n)])
    zeroed = per_tick.select(*[F.coalesce(F.nanvl(f"c{i}_{j}", F.lit(0.0)), F.lit(0.0)).alias(f"c{i}_{j}")
                               for i in range(n) for j in range(i + 1, n)])
    mean = zeroed.agg(*[F.avg(c).alias(c) for c in zeroed.columns])
    names = F.create_map(*[F.lit(x) for i in range(n) for j in range(i + 1, n) for x in (f"c{i}_{j}", f"{channel_names[i]}|{channel_names[j]}")])
    return mean.unpivot([], list(mean.columns), "pair", "corr").select(
        F.split(names[F.col("pair")], r"\|")[0].alias("a"), F.split(names[F.col("pair")], r"\|")[1].alias("b"), "corr",
        (F.abs("corr") >= 0.80).alias("strong"),
    )
