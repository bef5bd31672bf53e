"""Short lists of the segments that can be nearest, by square cells that are split where they are busy.

The nearest segment of any point of a cell is no farther from the cell's centre than the centre's own nearest one plus
the cell's diagonal.  So a cell lists the segments within that distance, and a cell inside it needs only look among
those.  Cells with points are split eight by eight, level by level, until their list is short; a level is a join, a grouped
minimum and a filter over (cell, segment) rows, and no list is gathered before it is short.  Segments of equal geometry
count once, as the first of them.

A point finds its list by its smallest cell, which stands for the longest listed cell around it; the answer is exact at any
distance.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import materialise

SIDES = [2.0**k for k in range(23, 4, -3)]  # metres, from a quarter of the globe to 32 m
SHORT = 16  # segments that a list may hold without a further split
SLACK_M = 1e-3  # for rounding


def located(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Rows that have a position, with the smallest cell it lies in."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    return known.withColumns({"_fx": _cell(F.col(x), SIDES[-1]), "_fy": _cell(F.col(y), SIDES[-1])})


def _cell(v: Column, side: float) -> Column:
    return F.floor(v / side)


def _up(cell: Column, fine: int, coarse: int) -> Column:
    """The cell of level ``coarse`` around a cell of level ``fine``."""
    return F.floor(cell / (SIDES[coarse] / SIDES[fine])).cast("bigint")


def segment_lists(points: DataFrame, segments: DataFrame, keys: Sequence[str] = (), short: int = SHORT) -> DataFrame:
    """(keys, ``_fx``, ``_fy``, ``segs``) for every smallest cell with ``points`` (as by ``located``): what can be nearest there.

    ``segments``: keys, ``shape_id, seg_no, x0, y0, x1, y1, cum_m, len_m``. Only segments of the point's keys are listed.
    """
    last = len(SIDES) - 1
    geometry = ["x0", "y0", "x1", "y1"]
    rest = [c for c in ("shape_id", "seg_no", "cum_m", "len_m") if c not in keys]
    first = F.min(F.struct(*rest)).alias("_s")
    each = materialise(segments.groupBy(*keys, *geometry).agg(first).select(*keys, F.struct(*[F.col(f"_s.{c}").alias(c) for c in rest], *geometry).alias("seg")), "segments")
    cells = materialise(points.select(*keys, "_fx", "_fy").distinct(), "cells")
    at = lambda level: [_up(F.col("_fx"), last, level).alias("cx"), _up(F.col("_fy"), last, level).alias("cy")]
    leaves, open_cells = [], None
    for level, side in enumerate(SIDES):
        here = cells.select(*keys, *at(level)).distinct()
        if open_cells is None:
            if keys:
                found = each.join(here, list(keys))
            else:  # a few cells cover the globe
                roots = here.agg(F.collect_set(F.struct("cx", "cy")).alias("_roots")).scalar()
                found = each.select("seg", F.inline(roots))
        else:
            inner = here.withColumns({"_px": _up(F.col("cx"), level, level - 1), "_py": _up(F.col("cy"), level, level - 1)})
            outer = open_cells.withColumnsRenamed({"cx": "_px", "cy": "_py"})
            found = outer.join(inner, [*keys, "_px", "_py"]).drop("_px", "_py")
        centre = geo.project_on_segment((F.col("cx") + 0.5) * side, (F.col("cy") + 0.5) * side, F.col("seg"))["orth_m"]
        measured = found.withColumn("_d", centre)
        least = measured.groupBy(*keys, "cx", "cy").agg(F.min("_d").alias("_least"))
        near = materialise(
            measured.join(least, [*keys, "cx", "cy"]).filter(F.col("_d") <= F.col("_least") + side * math.sqrt(2.0) + SLACK_M)
            .select(*keys, "cx", "cy", "seg"), "near")
        if level == last:
            leaves.append((level, near))
            break
        sizes = materialise(near.groupBy(*keys, "cx", "cy").agg((F.count("*") > short).alias("long")), "sizes")
        done = sizes.filter("not long").drop("long")
        leaves.append((level, near.join(done, [*keys, "cx", "cy"], "left_semi")))
        open_cells = near.join(sizes.filter("long").drop("long"), [*keys, "cx", "cy"], "left_semi")
        if sizes.filter("long").isEmpty():
            break
    lists = None
    for level, rows in leaves:
        part = rows.groupBy(*keys, "cx", "cy").agg(F.collect_list("seg").alias("segs")).withColumn("_level", F.lit(level))
        lists = part if lists is None else lists.unionByName(part)
    around = cells.select("*", F.inline(F.array(*[F.struct(F.lit(level).alias("_level"), *at(level)) for level, _ in leaves])))
    return materialise(around.join(lists, [*keys, "_level", "cx", "cy"]).select(*keys, "_fx", "_fy", "segs"), "lists")
