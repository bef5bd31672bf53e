"""Exact order statistics per group by counting in ranges, a round at a time.

A double's bits, turned round for negatives, are a whole number in the same order.  A round cuts each group's own open
interval of these numbers by its highest differing bits, counts rows per part, and goes on with the part that holds the
wanted rank, until that part is one value.  A group's state is the counters of one round; rows outside every open
interval are left behind.  Ten bits a round make seven rounds at most, whatever the values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

BITS = 10
_TOP = (1 << 63) - 1


def sortable(value):
    """A double as a long of the same order; -0.0 counts as 0.0 and NaN comes last."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), F.col(value).cast("double") + F.lit(0.0)).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(_TOP)))


def _same(left: str, right: str, keys: Sequence[str]):
    """Equal keys, null equal to null."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys], F.lit(True))


def order_statistics(rows: DataFrame, keys: Sequence[str], ranks: DataFrame, bits: int = BITS) -> DataFrame:
    """``ranks`` (keys, ``_n``, ``_k`` from 0) with ``_v``, the value of that rank among the group's rows.

    ``rows``: keys, ``_v`` and ``_code``, ``sortable`` of it.
    """
    ends = rows.groupBy(*keys).agg(F.min("_code").alias("_lo"), F.max("_code").alias("_hi"), F.min("_v").alias("_v"))
    open_ranks = materialise(
        ranks.alias("r").join(ends.alias("e"), _same("r", "e", keys)).select("r.*", "e._lo", "e._hi", "e._v", F.lit(0).cast("bigint").alias("_before")), "ranks")
    done, turn = [], 0
    cols = [*keys, "_n", "_k", "_v"]
    while True:
        done.append(open_ranks.filter("_lo = _hi").select(*cols))
        live = open_ranks.filter("_lo < _hi")
        if live.isEmpty():
            return reduce(DataFrame.unionByName, done)
        width = F.length(F.bin(F.col("_lo").bitwiseXOR(F.col("_hi"))))
        parts = live.select(*keys, "_lo", "_hi").distinct().withColumn("_shift", F.greatest(F.lit(0), width - bits))
        inside = rows.alias("x").join(
            parts.alias("p"), _same("x", "p", keys) & F.col("x._code").between(F.col("p._lo"), F.col("p._hi"))
        ).select(*[F.col(f"x.{k}") for k in keys], "_v", "_code", "_lo", F.expr("shiftright(_code, _shift)").alias("_part"))
        if turn:  # a small share of the rows: later rounds read only these
            inside = materialise(inside, "open-rows")
            rows = inside.select(*keys, "_v", "_code")
        counts = inside.groupBy(*keys, "_lo", "_part").agg(
            F.count("*").alias("_c"), F.min("_code").alias("_a"), F.max("_code").alias("_b"), F.min("_v").alias("_w"))
        before = Window.partitionBy(*keys, "_lo").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_under", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        rank = F.col("r._k") - F.col("r._before")
        open_ranks = materialise(
            live.alias("r").join(counts.alias("c"), _same("r", "c", keys) & (F.col("r._lo") == F.col("c._lo"))
                                 & (rank >= F.col("c._under")) & (rank < F.col("c._under") + F.col("c._c")))
            .select(*[F.col(f"r.{k}") for k in keys], "r._n", "r._k", F.col("c._a").alias("_lo"), F.col("c._b").alias("_hi"), F.col("c._w").alias("_v"),
                    (F.col("r._before") + F.col("c._under")).alias("_before")), "ranks")
        turn += 1


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """One row per group with a value: its exact quantiles, linear between neighbours. Without ``keys``
    one row, null where there is no value."""
    rows = materialise(
        df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), sortable(value).alias("_code")), "values")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 0")
    spot = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(spot(q)), F.ceil(spot(q))) for q in quantiles.values()])))
    found = order_statistics(rows, keys, sizes.select("*", F.explode(wanted).alias("_k")))
    at = lambda k: F.max(F.when(F.col("_k") == k, F.col("_v")))
    out = []
    for name, q in quantiles.items():
        low, high = at(F.floor(spot(q))), at(F.ceil(spot(q)))
        share = F.max(spot(q) - F.floor(spot(q)))
        out.append(F.when(low == high, low).otherwise(low + (high - low) * share).alias(name))
    return found.groupBy(*keys).agg(*out)
