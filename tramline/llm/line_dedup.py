"""Line-level dedup over a whole corpus, returning compressed keep bitmaps instead of text.

Line keys become 128-bit fingerprints with (document, position); rows are range-partitioned by (fingerprint,
document) and sorted by (fingerprint, document, position), so a line of a third of all documents spans several
partitions.  Each partition streams its runs: a run that has met enough documents drops the lines it held back and all
that follow; one cut by the partition's edge leaves a count per edge, and the counts of all edges (two per partition)
settle it.  Only dropped positions leave the stream; they become one bitmap per document.

Policies: ``all`` drops every line of a key found in ``min_docs`` documents; ``first`` keeps the first occurrence of
each such key (smallest document, smallest position).

Defined cases: null or empty text is one empty line (never dropped when ``min_chars`` is at least one); rows of one
``doc_id`` count as one document, but each text has its own bitmap; rows without ``doc_id`` count as one document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .words import _SPACE, Texts, batch_of, mix, row_of, slices

NO_ID = -(2**63)


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("version"),
                       F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def line_keys(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(a, b, doc, version, pos): one row per line whose key has at least ``min_chars`` code points."""
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "doc", "version")] + [("pos", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = Texts(part.column("text"), lower=True)
            starts, ends, first = texts.lines()
            row = row_of(first)
            pos = np.arange(len(starts)) - first[row]
            starts, ends = _stripped(texts.buf, starts, ends)
            heads = np.zeros(len(texts.buf) + 1, np.int64)
            np.cumsum((texts.buf & 0xC0) != 0x80, out=heads[1:])
            full = heads[ends] - heads[starts] >= min_chars
            starts, ends, row = starts[full], ends[full], row[full]
            a = texts.hashes(starts, ends)
            b = mix(texts.hashes(np.minimum(starts + 3, ends), ends), a)
            ids = [part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc", "version")]
            yield batch_of(schema, [a.view(np.int64), b.view(np.int64), *ids, pos[full].astype(np.int32)])

    return _identified(docs).select("doc", "version", "text").mapInArrow(cut, "a long, b long, doc long, version long, pos int")


def _stripped(buf, starts, ends):
    starts, ends = starts.copy(), ends.copy()
    live = np.flatnonzero(ends > starts)
    while len(live):
        live = live[_SPACE[buf[starts[live]]]]
        starts[live] += 1
        live = live[starts[live] < ends[live]]
    live = np.flatnonzero(ends > starts)
    while len(live):
        live = live[_SPACE[buf[ends[live] - 1]]]
        ends[live] -= 1
        live = live[starts[live] < ends[live]]
    return starts, ends


def _runs(min_docs: int):
    """Streams one sorted partition; kind 0: drop this line, 1: open until the edges are known, 2: documents at an edge.

    Held in memory: one batch, and the lines of the open run while it has met fewer than ``min_docs`` documents.
    """
    cols = ["a", "b", "doc", "version", "pos"]
    schema = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in cols], ("docs", pa.int64())])

    def emit(kind, rows, docs=0):
        n = len(rows["a"])
        return batch_of(schema, [np.full(n, kind, np.int32), *[rows[c] for c in cols], np.full(n, docs, np.int64)])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, last, held, first = None, 0, None, [], True

        def edge():
            """The open run touches an end of the partition: its count and its undecided lines."""
            yield emit(2, {c: np.array([key[k] if k < 2 else 0]) for k, c in enumerate(cols)}, docs)
            for rows in held:
                yield emit(1, rows)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in cols}
            new = np.ones(batch.num_rows, bool)
            new[1:] = (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])
            new[0] = key != (rows["a"][0], rows["b"][0])
            other = new.copy()
            other[1:] |= rows["doc"][1:] != rows["doc"][:-1]
            other[0] |= rows["doc"][0] != last
            bounds = np.unique(np.concatenate(([0], np.flatnonzero(new), [batch.num_rows])))
            met = np.add.reduceat(other.astype(np.int64), bounds[:-1])
            inside = np.repeat(met >= min_docs, np.diff(bounds))
            inside[: bounds[1]] = False
            inside[bounds[-2]:] = False
            if inside.any():  # runs that begin and end within the batch
                yield emit(0, {c: v[inside] for c, v in rows.items()})
            for run in dict.fromkeys((0, len(met) - 1)):
                lo, hi = bounds[run], bounds[run + 1]
                if new[lo]:
                    if key is not None and first:
                        yield from edge()
                    first = first and key is None and run == 0
                    key, docs, held = (rows["a"][lo], rows["b"][lo]), 0, []
                docs, last = docs + int(met[run]), rows["doc"][hi - 1]
                held.append({c: v[lo:hi] for c, v in rows.items()})
                if docs >= min_docs:
                    for part in held:
                        yield emit(0, part)
                    held = []
        if key is not None:
            yield from edge()

    return stream


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, policy: str = "all") -> DataFrame:
    """(doc, version, n_dropped, bitmap) of the documents that lose lines.

    ``bitmap`` is zlib-compressed, one bit per line, most significant first, set where the line stays; lines beyond
    its end stay.
    """
    if policy not in ("all", "first"):
        raise ValueError("policy is 'all' or 'first'")
    order = ["a", "b", "doc", "version", "pos"]
    keys = line_keys(docs, min_chars)
    spread = keys.repartitionByRange("a", "b", "doc").sortWithinPartitions(*order)
    found = stored(spread.mapInArrow(_runs(min_docs),
                                     "kind int, a long, b long, doc long, version long, pos long, docs long"), "line-runs")
    settled = found.where("kind = 2").groupBy("a", "b").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    dropped = found.where("kind = 0").drop("kind", "docs").unionByName(
        found.where("kind = 1").drop("kind", "docs").join(settled.select("a", "b"), ["a", "b"], "left_semi"))
    if policy == "first":
        first = dropped.groupBy("a", "b").agg(F.min(F.struct("doc", "version", "pos")).alias("first"))
        dropped = dropped.join(first, ["a", "b"]).where(F.struct("doc", "version", "pos") != F.col("first"))

    @F.pandas_udf("binary")
    def packed(positions: pd.Series) -> pd.Series:
        def one(pos):
            keep = np.ones((int(max(pos)) + 8) // 8 * 8, bool)
            keep[pos] = False
            return zlib.compress(np.packbits(keep).tobytes())
        return positions.map(one)

    return dropped.groupBy("doc", "version").agg(F.collect_set(F.col("pos").cast("int")).alias("gone")).select(
        "doc", "version", F.size("gone").cast("long").alias("n_dropped"), packed("gone").alias("bitmap"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())])

    def apply(batches):
        for part in slices(batches):
            texts, lines = [], []
            for text, bitmap in zip(part.column("text").to_pylist(), part.column("bitmap").to_pylist(), strict=True):
                pieces = text.split("\n")
                lines.append(len(pieces))
                if bitmap is not None:
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
                    text = "\n".join(p for k, p in enumerate(pieces) if k >= len(keep) or keep[k])
                texts.append(text)
            yield batch_of(schema, [part.column("doc_id"), lines, part.column("n_dropped"), texts])

    rows = _identified(docs).join(bitmaps.hint("shuffle_hash"), ["doc", "version"], "left")
    return rows.select("doc_id", "text", "bitmap", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped")).mapInArrow(
        apply, "doc_id long, n_lines long, n_dropped long, kept_text string")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
