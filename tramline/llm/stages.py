"""Operators as pipeline stages: each takes and returns the columns of ``documents`` (the last adds its placement)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, mixing, near_dup, sharding
from .common import stored
from .queries import SHARDS, WEIGHTS, domain_of

MIN_SCORE = 0.4  # share of the best language below which a document has none


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without a letter, or with no language ahead of the others, go."""
    named = language.identify(docs, language.fit(docs), keep=tuple(docs.columns))
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select("row.*")


def row_key():
    """128 bits that name a (doc_id, text): two hashes of different seeds, so unlike rows do not share one by chance."""
    parts = [F.col("doc_id"), F.col("text")]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(0x5EED), F.length("text"), *reversed(parts)).alias("b"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that of the lowest ``doc_id`` (null last).

    A document is a (doc_id, text): rows that agree in both are one, rows of one ``doc_id`` with other texts stand for
    themselves, and so do rows without ``doc_id``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = stored(docs.select(row_key().alias("key"), row.alias("row")).dropDuplicates(["key"]).withColumn("number", F.monotonically_increasing_id()),
                  "near-rows", codec="zstd")
    groups = near_dup.near_duplicate_components(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")))
    groups = stored(groups.where("component_id is not null").select(F.col("doc_id").alias("number"), F.col("component_id").alias("group")), "groups")
    several = stored(groups.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group"), "several")
    member = stored(groups.join(several, "group").join(rows.select("number", F.col("row.doc_id").alias("doc_id")), "number"), "member")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("number").alias("best"))).getField("best")
    gone = member.join(member.groupBy("group").agg(first.alias("best")), "group").where("number <> best").select("number")
    return rows.join(gone, "number", "left_anti").select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands; rows of one ``doc_id`` go each by its own text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = stored(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("number")), "leak-rows", codec="zstd")  # a row's number is stored with it
    hit = decontaminate.contaminations(rows.select(F.col("number").alias("doc_id"), "row.text"), benchmark)
    return rows.join(hit.select(F.col("doc_id").alias("number")).distinct(), "number", "left_anti").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights; one used in two epochs is two rows."""
    return mixing.mix_sources(docs, domain_of(), WEIGHTS, share=0.5, max_epochs=2).select("row.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot; columns of these names that ``docs`` brings give way."""
    own = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    return sharding.interleaved_shards(docs, SHARDS).select(*own, "shard", "slot")
