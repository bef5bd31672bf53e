"""Point-in-interval lookup as an equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_lookup(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    position: str,
    payload: Sequence[str],
    width: float,
) -> DataFrame:
    """Left lookup of the interval ``[lo, hi)`` of the same key that holds ``position``.

    Intervals of a key must not overlap. Each is listed under the cells of ``width`` it
    touches; a point joins its own cell, with the exact bounds as the rest of the join
    condition, so at most one row matches. A hash join inside generated code, no range join.
    Adds ``lo``, ``hi`` and the payload, null outside every interval.
    """
    cells = intervals.select(
        *keys, "lo", "hi", *payload,
        F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("_cell"),
    ).alias("cells")
    located = points.withColumn("_cell", F.floor(F.col(position) / width)).alias("points")
    on = (F.col("points._cell") == F.col("cells._cell")) & (F.col(f"points.{position}") >= F.col("cells.lo")) & (
        F.col(f"points.{position}") < F.col("cells.hi"))
    for k in keys:
        on = on & (F.col(f"points.{k}") == F.col(f"cells.{k}"))
    return located.join(cells, on, "left").select(
        *[F.col(f"points.{c}") for c in points.columns], *[F.col(f"cells.{c}") for c in ("lo", "hi", *payload)]
    )
