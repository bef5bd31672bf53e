"""Mixing sources to target weights by hierarchical budgeting.

A tree domain - language - source carries integer weights.  The token budget of a node is shared among its children
by weight; a child holds at most ``max_epochs`` times its tokens, and what it cannot hold goes to its siblings by
weight before anything is left to the level above (water-filling, level by level from the root; tokens are rounded
down at each node).  A leaf's budget is spent on whole epochs and then on a prefix of the next epoch's seeded order: documents as
long as their running token count stays within the rest.

Running counts in a leaf are sums per digest bucket plus the sum inside the bucket, so a leaf with a third of all rows
is spread over many tasks.

Defined cases: null domain, language or source is a child of its own with weight ``other``; weight 0 takes nothing;
text without words costs no tokens and comes with the prefix it stands in; a leaf without tokens gives nothing; rows
equal in id and size may take either's place; a budget above all capacity takes everything.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .sharding import seeded_digest

WORD = "[^\\x20\\x09-\\x0D]+"
LEVELS = ("domain", "lang", "source")


def _name(col: Column) -> Column:
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), col.cast("string")))


def _weight(node: Column, weights: Mapping[str, int], other: int) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, w in weights.items():
        out = out.when(node == f"v{name}", F.lit(int(w)))
    return out.otherwise(F.lit(int(other))).cast("long")


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], share: float, max_epochs: int, other: int = 1) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``budget`` tokens each; the tree is small beside the rows."""
    tree = leaves
    for level in LEVELS:
        tree = tree.withColumn(f"w_{level}", _weight(F.col(level), weights.get(level, {}), other))
    dead = F.expr(" or ".join(f"w_{x} = 0" for x in LEVELS))
    tree = tree.withColumn("cap", F.when(dead, 0).otherwise(F.col("tokens") * max_epochs))
    budget = leaves.agg(F.floor(F.sum("tokens") * F.lit(float(share))).cast("long").alias("budget"))
    held = budget.withColumn("root", F.lit(1))
    path: list[str] = ["root"]
    tree = tree.withColumn("root", F.lit(1))
    for level in LEVELS:
        nodes = tree.groupBy(*path, level).agg(F.sum("cap").alias("cap"), F.max(f"w_{level}").alias("w")).join(held, path)
        turn = Window.partitionBy(*path).orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))), level)
        before = turn.rowsBetween(Window.unboundedPreceding, -1)
        nodes = (
            nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            .withColumn("over", F.sum("w").over(Window.partitionBy(*path)) - F.coalesce(F.sum("w").over(before), F.lit(0)))
            .withColumn("level", F.when(F.col("over") > 0, F.col("left") / F.col("over")).otherwise(F.lit(0.0)))
            .withColumn("full", (F.col("w") > 0) & (F.col("cap") / F.col("w") <= F.col("level")))
        )
        # the first child that is not full sets the level of all that are not
        nodes = nodes.withColumn("mark", F.max(F.when(~F.col("full") & (F.col("w") > 0), F.col("level"))).over(Window.partitionBy(*path)))
        held = nodes.select(*path, level, F.when(F.col("w") == 0, F.lit(0)).when(F.col("full"), F.col("cap")).otherwise(
            F.least(F.col("cap"), F.floor(F.col("w") * F.col("mark")))).cast("long").alias("budget"))
        path = [*path, level]
    return held.drop("root")


def mix_sources(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], share: float = 0.5, max_epochs: int = 2,
                seed: str = "mix", digits: int = 3, other: int = 1) -> DataFrame:
    """``row`` (the input row as a struct), ``epoch`` from 0, ``n_tokens`` and the leaf's ``budget``: one row per use of a document.

    ``domain`` is computed from the columns of ``docs``; ``weights`` maps each level to weights by name.
    """
    rows = docs.select(
        F.struct("*").alias("row"), _name(domain).alias("domain"), _name(F.col("lang")).alias("lang"), _name(F.col("source")).alias("source"),
        F.coalesce(F.expr(f"regexp_count(cast(text as string), r'{WORD}')"), F.lit(0)).cast("long").alias("n_tokens"), F.col("doc_id").alias("id"),
    )
    sizes = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    leaves = stored(sizes, "mix-leaves")
    budgets = leaf_budgets(leaves, weights, share, max_epochs, other)
    plan = leaves.join(budgets, list(LEVELS)).where("tokens > 0 and budget > 0").select(
        *LEVELS, "budget", F.expr("cast(budget div tokens as int)").alias("whole"), F.expr("budget % tokens").alias("rest"))
    plan = stored(plan, "mix-plan")
    used = rows.join(F.broadcast(plan), list(LEVELS)) if _small(plan) else rows.join(plan, list(LEVELS))
    # whole epochs take every document; the next one is taken in seeded order as far as the rest goes
    whole = used.where("whole > 0").select("row", "n_tokens", "budget", F.explode(F.expr("sequence(0, whole - 1)")).alias("epoch"))
    part = used.where("rest > 0").withColumn("digest", seeded_digest(seed, F.col("whole"), F.col("id"))).withColumn(
        "bucket", F.substring("digest", 1, digits))
    key = [*LEVELS, "bucket"]
    sums = part.groupBy(*key).agg(F.sum("n_tokens").alias("here"))
    before = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, F.coalesce(F.sum("here").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*key).orderBy("digest", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = part.withColumn("upto", F.sum("n_tokens").over(inside)).join(sums, key).where("ahead + upto <= rest")
    return whole.unionByName(taken.select("row", "n_tokens", "budget", F.col("whole").alias("epoch")))


def _small(plan: DataFrame, most: int = 10_000) -> bool:
    """The leaf table may be broadcast: counted, not assumed."""
    return plan.limit(most + 1).count() <= most
