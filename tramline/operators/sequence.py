"""Ordered-row helpers that stay spread out when one key holds much of the data.

Plain windows are used only where the group has a bound (one trip instance keeps at most one
row per second of its service day, one tick keeps one row per bus). Keys without such a bound
(a feed, a vehicle over all history, a whole table) go through the chunked forms here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """One row per key, the one with the greatest ``version``. A partial aggregate, so copies
    of a hot key collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*version)).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)


def earliest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def previous_in_chunks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    previous: Mapping[str, Column],
) -> DataFrame:
    """``lag`` over ``keys`` ordered by ``order`` without one task per key.

    ``chunk`` must not decrease along ``order``. Rows are sorted inside ``(keys, chunk)``; only
    the first and last row of each chunk meet again per key, in a second window that leaves
    the other rows in their chunks. Exact: the previous row of a chunk's first row is the last
    row of the chunk before it.
    """
    names = list(previous)
    base = df.withColumns({"_chunk": chunk, "_vals": F.struct(*[previous[n].alias(n) for n in names])})
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    marked = base.withColumns(
        {
            "_prev": F.lag("_vals").over(inside),
            "_edge": (F.row_number().over(inside) == 1) | F.lead(F.lit(1)).over(inside).isNull(),
        }
    )
    lane = F.when(F.col("_edge"), F.lit(None).cast("string")).otherwise(F.col("_chunk").cast("string"))
    across = Window.partitionBy(*keys, "_lane").orderBy(*order)
    joined = marked.withColumn("_lane", lane).withColumn(
        "_prev",
        F.when(F.col("_edge") & F.col("_prev").isNull(), F.lag("_vals").over(across)).otherwise(
            F.col("_prev")
        ),
    )
    return joined.select(*df.columns, *[F.col(f"_prev.{n}").alias(n) for n in names])


def value_bounds(df: DataFrame, value: str, pieces: int = 256) -> DataFrame:
    """One row with split points of a numeric column, from a mergeable sketch."""
    probs = [i / pieces for i in range(1, pieces)]
    return df.agg(
        F.array_distinct(F.percentile_approx(value, probs, 10_000)).alias("_bounds")
    )


def cumulative_by_value(
    df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column], descending: bool = False
) -> DataFrame:
    """Running sums over distinct values of ``value`` per key, exact, with no global sort.

    Rows are first summed per distinct value, those sums are cut into value ranges by split
    points, running sums are taken inside a range, and the totals of the ranges before it are
    added. Output: one row per distinct value with the sums and ``cum_<name>`` columns.
    """
    names = list(sums)
    per_value = df.groupBy(*keys, value).agg(*[F.sum(sums[n]).alias(n) for n in names])
    bounds = value_bounds(per_value.select(F.col(value).cast("double").alias(value)), value)
    # never null, so that no null test on it is pushed below the aggregate
    bucket = F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(value))), F.lit(0))
    cut = (
        per_value.withColumn("_bounds", bounds.scalar())
        .withColumn("_bucket", (-bucket if descending else bucket))
        .drop("_bounds")
    )
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        cut.groupBy(*keys, "_bucket")
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(
            *keys,
            "_bucket",
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in names],
        )
    )
    return (
        cut.withColumns({f"_in_{n}": F.sum(n).over(inside) for n in names})
        .join(totals, [*keys, "_bucket"])
        .select(
            *keys,
            value,
            *names,
            *[(F.col(f"_in_{n}") + F.col(f"_before_{n}")).alias(f"cum_{n}") for n in names],
        )
    )
