"""Hard negatives by an inverted multi-index: exact windows of inner products around each anchor's positives.

Vectors are cut into two halves and each half has a codebook of ``CODES`` centres, learned from ``FIT_ROWS`` rows at
most (those of the smallest hash of ``vec_id``).  Every row is filed under its cell, a pair of centres.  Cells in order
are dealt into shards of about ``SHARD_ROWS`` rows, a cell with many rows into several; a shard is an index of its own,
with the radius of each centre's rows in it.  A half's score is at most ``q.centre + |q| * radius``; the multi-sequence
heap visits a shard's cells in falling order of the two halves' summed bounds, reads cells until some hundred rows are
together, scores them at once, and stops when nothing that is left can enter the answer.

1. Positives: the ``n_positives`` best rows of the anchor's label; the visit stops when the last of them beats the bound.
2. Negatives: for each positive the best rows of other labels with ``low_pct * positive <= 100 * negative <= 100 *
   positive``; the visit stops when each window is certified: full and its last row beats the bound, or the bound is below it.

Answers of all shards are merged by rank.  Nothing is approximate: the bounds decide what need not be read.  Anchors
meet a shard in blocks of ``BLOCK_ANCHORS``, so a task holds one shard and one block whatever the table's size.

Defined cases: rows with a null ``vec_id``, label or vector, or with a null, non-finite or over-large component (beyond
``LIMIT``) take no part.  Shorter vectors are filled up with zeros.  Ties go by smaller ``vec_id``.  Rows equal in id,
label and vector are one row; rows of one id that differ each count, but never for an anchor of that id, and the anchor
itself is the one of the smallest label and vector.  An anchor without a row of its label, or whose positives score
below zero, gives no rows.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .words import batch_of

CODES = 32
FIT_ROWS = 16_384
ROUNDS = 8
SHARD_ROWS = 16_384
BLOCK_ANCHORS = 2_048
READ_ROWS = 1_024  # rows scored at once
LIMIT = float(1 << 26)  # of a component, so that scores of up to 1,024 components fit a long


def usable_rows(vectors: DataFrame, vec_id: str = "vec_id", label="label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, v): the rows that take part, each component x as floor(scale * x)."""
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("int").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * scale > LIMIT))
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("double"))
    return rows.where("vec_id is not null and label is not null and v is not null").where(~odd).select("vec_id", "label", whole.alias("v"))


class Codebooks:
    """Two halves' centres, by Lloyd's rounds from seeded rows."""

    def __init__(self, sample: np.ndarray, width: int, codes: int = CODES, seed: int = 7):
        self.width, self.cut = width, width // 2
        rng = np.random.default_rng(seed)
        self.centres = []
        for half in (sample[:, : self.cut], sample[:, self.cut:]):
            distinct = np.unique(half, axis=0) if len(half) else np.zeros((1, half.shape[1]))
            centres = distinct[rng.permutation(len(distinct))[:codes]].astype(np.float64)
            for _ in range(ROUNDS):
                near = self._near(half, centres) if len(half) else np.zeros(0, np.int64)
                for c in np.unique(near):
                    centres[c] = half[near == c].mean(0)
            self.centres.append(centres)

    @staticmethod
    def _near(half, centres):
        return np.argmin((centres**2).sum(1) - 2 * half @ centres.T, axis=1)

    def halves(self, x: np.ndarray):
        return x[:, : self.cut], x[:, self.cut:]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(self._near(half, centres) for half, centres in zip(self.halves(x), self.centres, strict=True))


def fit(rows: DataFrame, codes: int = CODES, fit_rows: int = FIT_ROWS) -> Codebooks:
    """Codebooks from ``fit_rows`` rows at most, whatever the size of the table."""
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    sample = rows.select("v", F.xxhash64("vec_id").alias("turn"), "vec_id", "label").orderBy("turn", "vec_id", "label", "v").limit(fit_rows)
    return Codebooks(_matrix([r.v for r in sample.select("v").collect()], width), width, codes)


def _matrix(lists, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for k, x in enumerate(lists):
        out[k, : len(x)] = x
    return out


def file_rows(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, one, two, v): every row with its cell; ``v`` as packed whole numbers of four bytes."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("one", pa.int32()), ("two", pa.int32()), ("v", pa.binary())])

    def assign(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                column = part.column("v")
                size = column.value_lengths().to_numpy(zero_copy_only=False)
                flat = column.flatten().to_numpy(zero_copy_only=False)
                if (size == books.width).all():
                    x = flat.reshape(-1, books.width)
                else:
                    x = np.zeros((len(size), books.width))
                    x[np.arange(books.width) < size[:, None]] = flat
                one, two = books.cells(x)
                packed = x.astype("<i4")
                yield batch_of(schema, [part.column("vec_id"), part.column("label"), one.astype(np.int32), two.astype(np.int32), [r.tobytes() for r in packed]])

    return rows.mapInArrow(assign, "vec_id long, label int, one int, two int, v binary")


def deal_shards(filed: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The rows with a ``shard``: cells in order, cut every ``shard_rows`` rows or so; and the number of shards.

    A cell takes a stretch of places as long as its count, and a row the place that its hash names in it, so that equal
    rows share a shard and a large cell fills several.  The counts are at most ``CODES`` squared rows.
    """
    counts = filed.groupBy("one", "two").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("one", "two").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("before", before)
    total = filed.count()
    spot = F.col("before") + F.pmod(F.xxhash64("vec_id", "v"), F.col("n"))
    return filed.join(placed, ["one", "two"]).select("vec_id", "label", "one", "two", "v", F.floor(spot / shard_rows).cast("int").alias("shard")), -(-total // shard_rows)


class Shard:
    """The rows of one shard sorted by cell, and the radius of each centre's rows."""

    def __init__(self, rows: pd.DataFrame, books: Codebooks):
        x = np.frombuffer(b"".join(rows["v"]), "<i4").reshape(len(rows), books.width)
        ids, labels = rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        cell = rows["one"].to_numpy(np.int64) * len(books.centres[1]) + rows["two"].to_numpy(np.int64)
        order = np.lexsort((*(x.T[::-1] if len(np.unique(ids)) < len(ids) else ()), labels, ids, cell))
        x, ids, labels, cell = x[order], ids[order], labels[order], cell[order]
        same = np.zeros(len(ids), bool)  # rows equal to the one before
        same[1:] = (ids[1:] == ids[:-1]) & (labels[1:] == labels[:-1]) & (cell[1:] == cell[:-1])
        same[np.flatnonzero(same)] = (x[same] == x[np.flatnonzero(same) - 1]).all(1)
        x, self.ids, self.labels, cell = x[~same], ids[~same], labels[~same], cell[~same]
        self.books, self.top = books, int(np.abs(x.astype(np.int64)).max(initial=0))
        self.x, self.whole = x.astype(np.float64), x.astype(np.int64)
        self.codes, self.radius, coded = [], [], []
        for half, centres, code in zip(books.halves(self.x), books.centres, (cell // len(books.centres[1]), cell % len(books.centres[1])), strict=True):
            used, at = np.unique(code, return_inverse=True)
            far = np.zeros(len(used))
            np.maximum.at(far, at, np.sqrt(((half - centres[code]) ** 2).sum(1)))
            self.codes.append(used)
            self.radius.append(far)
            coded.append(at)
        cells, start = np.unique(coded[0] * len(self.codes[1]) + coded[1], return_index=True)
        self.span = dict(zip(cells.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(cell)], strict=True), strict=True))

    def bounds(self, q: np.ndarray) -> list[np.ndarray]:
        """Per half, the highest score of a row of each centre, a little above for rounding."""
        out = []
        for part, centres, codes, radius in zip((q[: self.books.cut], q[self.books.cut:]), self.books.centres, self.codes, self.radius, strict=True):
            near, far = centres[codes] @ part, np.sqrt(part @ part) * radius
            out.append(near + far + 1e-9 * (np.abs(near) + far) + 1e-6)
        return out

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products: floats while every partial sum is a whole number below 2^53, else long integers."""
        if self.top * float(np.abs(q).max(initial=0)) * max(1, len(q)) < 2**53:
            return (self.x[at] @ q).astype(np.int64)
        return self.whole[at] @ q.astype(np.int64)

    def visit(self, q: np.ndarray):
        """(rows, bound): row numbers in portions, and what no row after them exceeds; cells by falling bound."""
        first, second = self.bounds(q)
        one, two = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        first, second = first[one].tolist(), second[two].tolist()
        one, two, width = one.tolist(), two.tolist(), len(second)
        heap, held, n = [(-(first[0] + second[0]), 0, 0)], [], 0
        while heap:
            _, i, j = heapq.heappop(heap)
            if j + 1 < width:
                heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(first):  # each pair is reached once: along its row, rows from their first pair
                heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))
            span = self.span.get(one[i] * width + two[j])
            if span:
                held.append(span)
                n += span[1] - span[0]
            if n >= READ_ROWS or not heap and held:
                yield np.concatenate([np.arange(a, b) for a, b in held]), -heap[0][0] if heap else -np.inf
                held, n = [], 0

    def positives(self, anchor: int, label: int, q: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at, bound in self.visit(q):
            at = at[(self.labels[at] == label) & (self.ids[at] != anchor)]
            score, ids = _best(np.append(score, self.scores(at, q)), np.append(ids, self.ids[at]), count)
            if len(ids) == count and score[-1] > bound:
                break
        return score, ids

    def negatives(self, anchor: int, label: int, q: np.ndarray, positive: np.ndarray, low_pct: int, count: int) -> list:
        """(scores, ids) per positive score."""
        floor = -(-low_pct * positive // 100)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(positive)
        live = [k for k in range(len(positive)) if floor[k] <= positive[k]]
        for at, bound in self.visit(q) if live else ():
            at = at[(self.labels[at] != label) & (self.ids[at] != anchor)]
            score, ids = self.scores(at, q), self.ids[at]
            for k in live:
                fits = (score <= positive[k]) & (score >= floor[k])
                found[k] = _best(np.append(found[k][0], score[fits]), np.append(found[k][1], ids[fits]), count)
            live = [k for k in live if bound >= floor[k] and not (len(found[k][0]) == count and found[k][0][-1] > bound)]
            if not live:
                break
        return found


def _best(score, ids, count):
    order = np.lexsort((ids, -score))[:count]
    return score[order], ids[order]


def _against_shards(shards: DataFrame, asks: DataFrame, n_shards: int, n_anchors: int, answer, schema: str) -> DataFrame:
    """``answer(shard rows, asks)`` for each shard and block of anchors; the rows go once per block, the anchors once per shard."""
    blocks = max(1, -(-n_anchors // BLOCK_ANCHORS))
    block = F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int")
    rows = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asks.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_shards - 1)))))
    return rows.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(answer, schema)


def hard_negatives(rows: DataFrame, is_anchor, n_positives: int = 5, n_negatives: int = 5, low_pct: int = 80, codes: int = CODES,
                   fit_rows: int = FIT_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``usable_rows``."""
    books = fit(rows, codes, fit_rows)
    filed = stored(file_rows(rows, books), "cells")
    shards, n_shards = deal_shards(filed, shard_rows)
    shards = stored(shards, "shards")
    anchors = stored(filed.where(is_anchor).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("a"))
                     .select("anchor_id", "a.label", "a.v"), "anchors")
    n_anchors = anchors.count()

    def best_of_label(rows, asks):
        shard, out = Shard(rows, books) if len(rows) and len(asks) else None, []
        for anchor, label, v in zip(asks["anchor_id"], asks["label"], asks["v"], strict=True) if shard else ():
            score, ids = shard.positives(anchor, label, np.frombuffer(v, "<i4").astype(np.float64), n_positives)
            out += zip([anchor] * len(ids), ids.tolist(), score.tolist(), strict=True)
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"]).astype("int64")

    def windows(rows, asks):
        shard, out = Shard(rows, books) if len(rows) and len(asks) else None, []
        for anchor, label, v, positives in zip(asks["anchor_id"], asks["label"], asks["v"], asks["positives"], strict=True) if shard else ():
            ids, scores = [p["positive_id"] for p in positives], np.array([p["positive_score"] for p in positives], np.int64)
            found = shard.negatives(anchor, label, np.frombuffer(v, "<i4").astype(np.float64), scores, low_pct, n_negatives)
            for positive, positive_score, (score, negative) in zip(ids, scores.tolist(), found, strict=True):
                out += [(anchor, positive, positive_score, n, s) for n, s in zip(negative.tolist(), score.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]).astype("int64")

    near = _against_shards(shards, anchors, n_shards, n_anchors, best_of_label, "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = near.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= n_positives)
    asks = stored(anchors.join(positives.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")), "anchor_id"), "positives")
    far = _against_shards(shards, asks, n_shards, n_anchors, windows,
                          "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
