"""Shared steps of the operators: tables, stored intermediates, graph components."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, shared_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_part(doc_id, modulus: int):
    """crc32 of the id's text, modulo; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def held_out(doc_id: str, modulus: int):
    """True where the remainder is 2; a null id has none and is not held out."""
    return F.coalesce(crc_part(doc_id, modulus) == 2, F.lit(False))


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Written once to the shared folder: cuts lineage and survives lost executors.

    The shuffle files of the write go with its end, where Spark can do so, not when the driver happens to collect its
    garbage: else those of all steps add up on disk.
    """
    spark = df.sparkSession
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        if codec is None:
            return materialise(df, f"llm-{name}")
        path = shared_dir(spark, f"llm-{name}")
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


FEW_LINKS = 100_000  # links that one task may hold: some megabytes


def _joined_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, component) of all links of one partition, by union-find towards the smaller node."""
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    for links in batches:
        for u, v in zip(links["u"].tolist(), links["v"].tolist(), strict=True):
            u, v = root(u), root(v)
            parent[max(u, v)] = min(u, v)
    yield pd.DataFrame({"node": list(parent), "component": [root(x) for x in parent]}, dtype="int64")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges`` (whole numbers): the smallest node reachable.

    Up to ``FEW_LINKS`` different links, counted first, are joined up in one task.  More go through alternating large-star
    and small-star rounds: each is two grouped minima and two hash joins whose built side has one row a node, so a node with
    very many links is split like any skewed join, and no component meets in one task.
    """
    links = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    if links.count() <= FEW_LINKS:
        return links.coalesce(1).mapInPandas(_joined_up, "node long, component long")
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("shuffle_hash"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low.hint("shuffle_hash"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        seen = Observation()
        links = stored(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "links")
        now = (seen.get["n"], seen.get["sum"])
        if now == mark or not now[0]:
            break
        mark = now
    return (
        links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .groupBy("node").agg(F.min("component").alias("component"))
    )
