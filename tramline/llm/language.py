"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to ``ORDER`` with frozen counts.  A byte costs -log2 c / (T + d) bits in
the longest context that has seen it, after -log2 d / (T + d) bits for the escape from every longer context seen (method C; c:
count of the byte in the context, T: all bytes, d: distinct bytes there) and 8 bits below order 0.  The language with the
shortest exact code of the whole text is predicted.

The trees of all languages share one hash table per order, whose rows hold the resolved cost of a string in every
language, so a byte takes one lookup where its longest context is known.

Fitting uses a bounded sample: each language of the training rows gives its documents in the order of a seeded hash until
its share is full, the last one cut there, so every language is learned from one document at least.  A share is ``fit_bytes`` by the number
of languages, but no less than ``LEAST_BYTES``; repeated rows count once.  All documents are scored over all their bytes.

Defined cases: null text, or text without a letter, is ``und`` with score 0; so is everything if nothing can be learned; ties
go to the first language by name; rows are scored one by one, so repeated rows agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import held_out
from .words import Texts, batch_of, slices

ORDER = 4
FIT_BYTES, LEAST_BYTES = 1 << 20, 1 << 14
STEP = 1 << 17  # bytes scored at once
TEMPER = 20.0


class Strings:
    """An open-addressing table of fixed-length byte strings (as integers), read by whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, self.probes = np.arange(len(keys), dtype=np.int32), 0
        while len(left):
            slot = self._slot(keys[left], self.probes)
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            left = left[self.slots[slot] != left]
            self.probes += 1

    def _slot(self, keys, probe):
        return ((((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)) + np.uint64(probe)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        live = np.arange(len(keys))
        for probe in range(self.probes):
            at = self.slots[self._slot(keys[live], probe)]
            same = (at >= 0) & (self.keys[at] == keys[live])
            out[live[same]] = at[same]
            live = live[(at >= 0) & ~same]
            if not len(live):
                break
        return out


def padded(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with ORDER zeros before each row, offsets of the rows' own bytes)."""
    rows = texts.rows
    size = np.diff(texts.offsets)
    begin = texts.offsets[:-1] + ORDER * (np.arange(rows) + 1)
    out = np.zeros(int(texts.offsets[-1]) + ORDER * rows, np.uint8)
    real = np.ones(len(out), bool)
    for k in range(1, ORDER + 1):
        real[begin - k] = False
    out[real] = texts.buf[: int(texts.offsets[-1])]
    return out, np.stack((begin, begin + size))


def grams(buf: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes ending at each position, as integers."""
    key = np.zeros(len(at), np.uint64)
    for k in range(size - 1, -1, -1):
        key = (key << np.uint64(8)) | buf[at - k]
    return key


class ContextTrees:
    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        n = len(self.langs)
        counts: list[list] = [[] for _ in range(ORDER + 1)]
        for texts in (Texts(pa.array(samples[x], pa.string())) for x in self.langs):
            buf, (begin, end) = padded(texts)
            inside = np.zeros(len(buf) + 1, np.int64)
            np.add.at(inside, begin, 1)
            np.add.at(inside, end, -1)
            at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
            for k in range(ORDER + 1):
                counts[k].append(np.unique(grams(buf, at, k + 1), return_counts=True))
        self.tables, self.costs = [], []
        self.contexts: list[Strings] = []
        self.escapes: list[np.ndarray] = []  # [k][context, language]: bits of leaving order k, 0 where it was not seen
        floor = np.full((1, n), 8.0)
        for k in range(ORDER + 1):
            keys = np.unique(np.concatenate([u for u, _ in counts[k]]))
            table = Strings(keys)
            if k:
                below = self.costs[k - 1][self.tables[k - 1].find(keys & np.uint64((1 << (8 * k)) - 1))]
            else:
                below = floor[np.zeros(len(keys), int)]
            known = Strings(np.unique(keys >> np.uint64(8)))
            contexts, width = known.find(keys >> np.uint64(8)), len(known.keys)
            cost = np.empty((len(keys), n))
            escape = np.zeros((width, n))
            for lang, (own, c) in enumerate(counts[k]):
                row = table.find(own)
                total = np.bincount(contexts[row], c, width)
                distinct = np.bincount(contexts[row], minlength=width)
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape[:, lang] = np.where(distinct > 0, -np.log2(distinct / (total + distinct)), 0.0)
                cost[:, lang] = escape[contexts, lang] + below[:, lang]
                cost[row, lang] = -np.log2(c / (total + distinct)[contexts[row]])
            self.tables.append(table)
            self.contexts.append(known)
            self.costs.append(cost.astype(np.float32))
            self.escapes.append(escape.astype(np.float32))

    def code_lengths(self, texts: Texts) -> np.ndarray:
        """[row, language]: bits of each text."""
        buf, (begin, end) = padded(texts)
        out = np.zeros((texts.rows, len(self.langs)))
        size = end - begin
        total = np.concatenate(([0], np.cumsum(size)))
        for lo in range(0, int(total[-1]), STEP):
            step = np.arange(lo, min(lo + STEP, int(total[-1])))
            row = np.searchsorted(total, step, "right") - 1
            at = step - total[row] + begin[row]
            for k in range(ORDER, -1, -1):
                found = self.tables[k].find(grams(buf, at, k + 1))
                self._add(out, row, self.costs[k], found)
                miss = found < 0
                at, row = at[miss], row[miss]
                if not len(at):
                    break
                self._add(out, row, self.escapes[k], self.contexts[k].find(grams(buf, at - 1, k)))
            if len(row):
                np.add.at(out, row, 8.0)
        return out

    @staticmethod
    def _add(out, row, costs, found):
        hit = found >= 0
        if hit.any():
            row = row[hit]
            cut = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            out[row[cut]] += np.add.reduceat(costs[found[hit]], cut, 0, dtype=np.float64)


def fit(docs: DataFrame, modulus: int = 4, fit_bytes: int = FIT_BYTES) -> ContextTrees | None:
    """Context trees from a bounded sample of the documents that are not held out."""
    text = F.col("text").cast("string")
    turn = F.shiftrightunsigned(F.xxhash64(F.lit("fit"), F.col("doc_id"), F.col("text")), 1)
    level = F.length(F.bin("turn"))  # levels are ranges of turns, each twice as wide as the one before
    rows = docs.where(~held_out("doc_id", modulus) & F.col("lang").isNotNull() & (F.octet_length(text) > 0)).select("lang", turn.alias("turn"), text.cast("binary").alias("body"))
    once = rows.groupBy("lang", "turn").agg(F.max(F.octet_length("body")).alias("bytes"))  # a row repeated often is drawn as one
    there: dict[str, list] = {}
    for r in once.groupBy("lang", level.alias("level")).agg(F.sum("bytes").alias("bytes")).orderBy("lang", "level").collect():
        there.setdefault(r.lang, []).append((r.level, r.bytes))
    if not there:
        return None
    share = min(max(fit_bytes // len(there), LEAST_BYTES), (1 << 31) - 1)
    last = {}
    for lang, levels in there.items():
        total = 0
        for step, size in levels:
            if total < share:
                last[lang], total = step, total + size
    stop = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    drawn = rows.where(level <= stop[F.col("lang")]).select("lang", "turn", F.substring("body", 1, share).alias("body")).distinct()
    samples: dict[str, list[str]] = {}
    left = dict.fromkeys(there, share)
    for r in drawn.orderBy("lang", "turn").collect():
        if left[r.lang] > 0:
            samples.setdefault(r.lang, []).append(bytes(r.body[: left[r.lang]]).decode("utf-8", "ignore"))
            left[r.lang] -= len(r.body)
    return ContextTrees(samples)


def identify(docs: DataFrame, trees: ContextTrees | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns), lang_pred, score and bits_per_byte for every row of ``docs``.

    ``score`` is the share of the best language when the average advantage per byte counts ``TEMPER`` bytes.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*keep).alias("row"), F.when(text.rlike(r"\p{L}"), text).alias("text"))
    out = StructType().add("row", docs.select(*keep).schema).add("lang_pred", StringType()).add("score", DoubleType()).add("bits_per_byte", DoubleType())
    schema = to_arrow_schema(out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            column = part.column("text")
            names = ["und"] * part.num_rows
            sure = np.zeros(part.num_rows)
            rate = np.zeros(part.num_rows)
            if trees is not None:
                texts = Texts(column)
                bits = trees.code_lengths(texts)
                size = np.maximum(np.diff(texts.offsets), 1)
                best = bits.argmin(1)
                least = bits[np.arange(len(best)), best]
                gap = (bits - least[:, None]) * np.minimum(1.0, TEMPER / size)[:, None]
                sure = 1 / np.exp2(-gap).sum(1)
                rate = least / size
                given = column.is_valid().to_numpy(zero_copy_only=False)
                names = [trees.langs[b] if g else "und" for b, g in zip(best, given, strict=True)]
                sure, rate = np.where(given, sure, 0.0), np.where(given, rate, 0.0)
            row = part.column("row")
            yield batch_of(schema, [row.cast(schema.field("row").type), names, sure, rate])

    return rows.mapInArrow(score, out)
