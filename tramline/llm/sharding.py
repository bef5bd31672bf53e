"""Shards that all match the mixture of sources, by proportional stratified interleaving.

Rows of a source are shuffled by a seeded digest and ranked; rank r of n gets the fraction (2r - 1) / 2n.  All rows sorted
by that fraction interleave the sources in proportion, and equal cuts of the order are the shards: counts differ by
at most one (law ``rows``), and every shard holds each source's share up to a row or two.

Both ranks are counted in two steps, so that no source and no order meets in one task: counts per digest (or
fraction) bucket, their running sum, and the row number inside the bucket.  Native functions only.

Defined cases: null source is a stratum of its own; null text has size 16 and the checksum of no bytes; rows that are
equal in all columns get neighbouring slots in either order; an empty table gives no rows.  Equal texts are rows like
any other: the law fixes counts, so a large group of copies is spread, not kept together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPREAD = 4096  # fraction buckets


def seeded_digest(seed: str, *parts):
    """Hex digest of the seed and ``parts``; the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def text_checksum(text: str = "text"):
    return F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def interleaved_shards(docs: DataFrame, shards: int, seed: str = "shards", stratum: str = "source", digits: int = 3,
                       checksum: Column | None = None) -> DataFrame:
    """``row`` (the input row as a struct), ``shard`` and ``slot`` (gapless from 0 within the shard).

    ``digits`` hex digits of the digest make the buckets of a stratum (16 ** digits); ``checksum`` (of the text, unless
    given) orders rows of one ``doc_id``.
    """
    rows = docs.select(
        F.struct("*").alias("row"),
        F.concat(F.when(F.col(stratum).isNull(), "n").otherwise("v"), F.coalesce(F.col(stratum).cast("string"), F.lit(""))).alias("stratum"),
        seeded_digest(seed, F.col("doc_id")).alias("digest"), (text_checksum() if checksum is None else checksum).alias("crc"),
    ).withColumn("bucket", F.substring("digest", 1, digits))
    tie = ["digest", "crc"]

    counts = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("here"))
    before = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("stratum", "bucket", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("ahead"),
                           F.sum("here").over(Window.partitionBy("stratum")).alias("in_stratum"))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy(*tie))).join(
        counts, ["stratum", "bucket"])
    ranked = ranked.select("row", "stratum", *tie, ((2 * (F.col("ahead") + F.col("nth")) - 1) / (2 * F.col("in_stratum"))).alias("fraction"))
    ranked = ranked.withColumn("cell", F.floor(F.col("fraction") * SPREAD))

    cells = counts_of_cells(rows, counts)
    placed = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("cell").orderBy("fraction", "stratum", *tie))).join(cells, "cell")
    at = F.col("ahead") + F.col("nth") - 1
    return placed.select("row", at.alias("at"), F.expr(f"cast((ahead + nth - 1) * {shards} div total as int)").alias("shard"), "total").select(
        "row", "shard", (F.col("at") - F.expr(f"(cast(shard as bigint) * total + {shards - 1}) div {shards}")).alias("slot"))


def counts_of_cells(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows ahead of each fraction bucket, and all rows; follows from the strata's sizes alone."""
    strata = counts.groupBy("stratum").agg(F.max("in_stratum").alias("n"))
    # ranks r with floor((2r - 1) / 2n * SPREAD) = cell, counted per stratum by where each cell begins
    per = strata.select("stratum", "n", F.explode(F.expr(f"sequence(0, {SPREAD - 1})")).alias("cell")).select(
        "cell", (_below("cell + 1") - _below("cell")).alias("here"))
    cells = per.groupBy("cell").agg(F.sum("here").alias("here"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.select(F.col("cell").cast("long").alias("cell"), F.coalesce(F.sum("here").over(before), F.lit(0)).alias("ahead"),
                        F.sum("here").over(Window.partitionBy()).alias("total"))


def _below(cell: str):
    """Ranks whose fraction lies below ``cell`` / SPREAD: 2r - 1 < 2n * cell / SPREAD."""
    return F.expr(f"(2 * n * ({cell}) + {SPREAD - 1}) div {SPREAD} div 2")
