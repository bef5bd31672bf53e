"""Documents to training shards: language, near duplicates, benchmark leaks, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tramline.llm import stages
from tramline.llm.common import documents, stored

STAGES = [
    ("language", stages.language_stage),
    ("near_duplicates", stages.near_dup_stage),
    ("decontamination", stages.decontamination_stage),
    ("mixture", stages.mixing_stage),
    ("shards", stages.sharding_stage),
]
ORACLE_SQL = None  # language models and LSH are not SQL; tests compare each stage but mixing with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
