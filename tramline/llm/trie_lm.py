"""Language-model scores from an Elias-Fano n-gram trie.

The model interpolates bigrams with add-one unigrams: P(w | u) = (1 - a) P1(w) + a c(u, w) / c(u), with P1(w) = (c(w) + 1) /
(N + V + 1), and P(w | u) = P1(w) after a word never seen.  A trie node stores the quantised gain log10(P / ((1 - a)
P1)), so a text's score is a sum over its words plus the gains of the bigrams found in the trie.

Work goes by chunks and shards, both of bounded size, so nothing is whole in one place and shards grow in number with the
corpus.  A chunk is a slice of documents with its own vocabulary; it asks the shards of the unigram table for the
counts of its distinct words, then sends its distinct bigrams, with the quantised log10 of c(u) P1(w) and the
training counts, to the shards of the trie.  A shard builds its part of the trie from what all chunks counted, answers
every chunk from the memory-mapped levels and is done.  A very frequent word's successors are dealt over ``SPLIT``
shards; a frequent bigram reaches its shard once per chunk.

Defined cases: null or empty text is the end token alone; rows without ``doc_id`` are training rows; repeated rows
count as often as they occur; without any training row every token is unknown (P1 = 1 / (N + V + 1) = 1).
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stored
from .words import Texts, batch_of, mix, slices

END = np.uint64(0x45A1D9C3B7F06E82)
SHARD_ITEMS = 1 << 19
SPLIT = 16
ALPHA = 0.5
_NORM_STEP, _NORM_LOW = 1 / 256, -14.0
_GAIN_STEP = 1 / 4096


def pack(values: np.ndarray) -> bytes:
    """Byte planes, compressed: the high bytes of small numbers are runs of zeros."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], n * kind.itemsize), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 values by their gaps."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


class EliasFano:
    """A monotone sequence: ``low`` bits of each value packed, the rest as gaps in a unary bit vector."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.count, self.low_bits, self.low, self.high = count, low_bits, low, high
        ones = np.flatnonzero(np.unpackbits(high, bitorder="little"))[:count]
        self.bucket = (ones - np.arange(count)).astype(np.int64)  # high part of each value
        top = int(self.bucket[-1]) + 2 if count else 1
        self.first = np.searchsorted(self.bucket, np.arange(top + 1))

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(low bits, packed low parts, unary high parts) of sorted uint64 ``values`` below ``universe``."""
        n = max(1, len(values))
        bits = max(0, min(56, (universe // n).bit_length() - 1))
        low = values & np.uint64((1 << bits) - 1)
        flags = ((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if bits else np.zeros((len(values), 0), np.uint8)
        packed = np.packbits(flags.ravel(), bitorder="little")
        high = (values >> np.uint64(bits)).astype(np.int64)
        unary = np.zeros(int(high[-1]) + len(values) + 1 if len(values) else 1, np.uint8)
        unary[high + np.arange(len(values))] = 1
        return bits, np.concatenate((packed, np.zeros(8, np.uint8))), np.packbits(unary, bitorder="little")

    def low_at(self, at: np.ndarray) -> np.ndarray:
        bit = at * self.low_bits
        eight = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        return (eight[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1: successor search inside the bucket of its high part."""
        out = np.full(len(values), -1, np.int64)
        if not self.count or not len(values):
            return out
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        fits = np.flatnonzero(high < len(self.first) - 1)
        lo, hi = self.first[high[fits]], self.first[high[fits] + 1]
        end = hi.copy()
        low = values[fits] & np.uint64((1 << self.low_bits) - 1)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            less = self.low_at(np.minimum(mid, self.count - 1)) < low
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        same = (lo < end) & (self.low_at(np.minimum(lo, self.count - 1)) == low)
        out[fits[same]] = lo[same]
        return out


class Trie:
    """Levels: words, contexts, pointers (first successor of each context) and successors with their gains.

    A successor is stored as (context number) * words + (word number), which is monotone; it is looked up relative to
    its context.  All levels lie in one file, read through a memory map.
    """

    def __init__(self, pairs: np.ndarray, gains: np.ndarray):
        """``pairs``: sorted distinct (context << 32 | word) fingerprints; ``gains``: log10 values."""
        context, word = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
        words, contexts = np.unique(word), np.unique(context)
        number = np.searchsorted(contexts, context).astype(np.uint64)
        pointers = np.searchsorted(number, np.arange(len(contexts), dtype=np.uint64)).astype(np.uint64)
        chained = number * np.uint64(max(1, len(words))) + np.searchsorted(words, word).astype(np.uint64)
        self.file = tempfile.TemporaryFile()  # unlinked at once: gone with the task
        levels, place = [], 0
        for values, universe in ((words, 1 << 32), (contexts, 1 << 32), (pointers, max(1, len(pairs))), (chained, max(1, len(words) * len(contexts)))):
            bits, low, high = EliasFano.encode(values, universe)
            self.file.write(low.tobytes() + high.tobytes())
            levels.append((len(values), bits, place, len(low), len(high)))
            place += len(low) + len(high)
        quantised = np.clip(np.round(gains / _GAIN_STEP), 0, 65535).astype(np.uint16)
        self.file.write(quantised.tobytes())
        self.file.flush()
        self.size = place + 2 * len(pairs)
        data = np.memmap(self.file, np.uint8, "r", shape=(max(1, self.size),)) if self.size else np.zeros(1, np.uint8)
        self.words, self.contexts, self.pointers, self.successors = (
            EliasFano(n, bits, data[at: at + a], data[at + a: at + a + b]) for n, bits, at, a, b in levels)
        self.gains = data[place: place + 2 * len(pairs)].view(np.uint16) if len(pairs) else np.zeros(0, np.uint16)

    def gain(self, pairs: np.ndarray) -> np.ndarray:
        """Gain of each (context << 32 | word), 0 where the trie has no such node."""
        context = self.contexts.find(pairs >> np.uint64(32))
        word = self.words.find(pairs & np.uint64(0xFFFFFFFF))
        known = np.flatnonzero((context >= 0) & (word >= 0))
        at = self.successors.find(context[known].astype(np.uint64) * np.uint64(max(1, self.words.count)) + word[known].astype(np.uint64))
        out = np.zeros(len(pairs))
        out[known[at >= 0]] = self.gains[at[at >= 0]] * _GAIN_STEP
        return out


def _chunks(docs: DataFrame, modulus: int) -> DataFrame:
    """One row per slice: documents, training flags, vocabulary fingerprints (sorted), their uses, and tokens by rank of use."""
    names = ["chunk", "ids", "train", "bounds", "vocab", "often", "ranks", "n_vocab", "n_train"]
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), *[(n, pa.binary()) for n in names[2:7]], ("n_vocab", pa.int64()), ("n_train", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id = TaskContext.get().partitionId()
        for seq, part in enumerate(slices(batches)):
            texts = Texts(part.column("text"), lower=True)
            starts, ends, first = texts.words()
            rows = texts.rows
            bounds = first + np.arange(rows + 1)
            hashed = np.empty(int(bounds[-1]), np.uint64)
            last = np.zeros(len(hashed), bool)
            last[bounds[1:] - 1] = True
            hashed[last] = END
            hashed[~last] = texts.hashes(starts, ends)
            vocab, tokens, often = np.unique(hashed, return_inverse=True, return_counts=True)
            rank = np.empty(len(vocab), np.uint32)
            rank[_by_use(often)] = np.arange(len(vocab))
            train = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            n_train = int(np.diff(bounds)[train].sum())
            yield batch_of(schema, [[(part_id << 32) + seq], pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), [pack(train.astype(np.uint8))],
                                    [pack(bounds.astype(np.int64))], [pack_sorted(vocab)], [pack(often.astype(np.uint32))], [pack(rank[tokens])], [len(vocab)], [n_train]])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out("doc_id", modulus).alias("held_out")).mapInArrow(
        cut, "chunk long, ids array<long>, train binary, bounds binary, vocab binary, often binary, ranks binary, n_vocab long, n_train long")


def _by_use(often):
    """Vocabulary numbers, most used first: frequent words get small numbers."""
    return np.argsort(-often.astype(np.int64), kind="stable")


def _tokens(r) -> np.ndarray:
    """A chunk's tokens as vocabulary numbers."""
    return _by_use(unpack(r["often"], np.uint32))[unpack(r["ranks"], np.uint32)]


def _counted(bounds, train, tokens, width):
    """Training count of each vocabulary number within a chunk."""
    return np.bincount(tokens[np.repeat(train.astype(bool), np.diff(bounds))], minlength=width).astype(np.uint32)


def _unigram_counts(chunks: DataFrame, shards: int) -> DataFrame:
    """(chunk, shard, counts, seen): corpus counts of each chunk's words, by ranges of the fingerprint."""
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def ask(batches):
        for batch in batches:
            for r in batch.to_pylist():
                vocab = unpack_sorted(r["vocab"])
                counts = _counted(unpack(r["bounds"], np.int64), unpack(r["train"], np.uint8), _tokens(r), len(vocab))
                cut = np.searchsorted(_range_of(vocab, shards), np.arange(shards + 1))
                yield batch_of(schema, [list(range(shards)), [r["chunk"]] * shards, [pack_sorted(vocab[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)],
                                        [pack(counts[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(x) for x in group["keys"]]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpack(x, np.uint32) for x in group["counts"]]), len(distinct)).astype(np.int64)
        parts = np.split(total[at], np.cumsum([len(k) for k in keys])[:-1])
        seen = [int((total > 0).sum())] + [0] * (len(group) - 1)
        return pd.DataFrame({"chunk": group["chunk"], "shard": group["shard"], "counts": [pack(p) for p in parts], "seen": seen})

    asked = chunks.select("chunk", "train", "bounds", "vocab", "often", "ranks").mapInArrow(ask, "shard int, chunk long, keys binary, counts binary")
    return asked.groupBy("shard").applyInPandas(answer, "chunk long, shard int, counts binary, seen long")


def _range_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def trie_scores(docs: DataFrame, modulus: int = 7, alpha: float = ALPHA, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    chunks = stored(_chunks(docs, modulus), "lm-chunks", "zstd")
    size = chunks.agg(F.coalesce(F.sum("n_vocab"), F.lit(0)).alias("asked"), F.coalesce(F.sum("n_train"), F.lit(0)).alias("train"),
                      F.count("*").alias("chunks")).first()
    counts = stored(_unigram_counts(chunks, int(size.asked) // shard_items + 1), "lm-unigrams", "zstd")
    n = int(size.train)
    v = int(counts.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0])
    shards = 2 * int(size.asked) // shard_items + 1  # about as many distinct bigrams again as words
    known = counts.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("shard", "counts"))).alias("known"))

    names = ["shard", "chunk", "keys", "many", "counts", "norms", "docs"]
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in names[2:]]])

    def ask(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from rows_of(r)

    def rows_of(r):
        vocab, tokens = unpack_sorted(r["vocab"]), _tokens(r)
        bounds, train = unpack(r["bounds"], np.int64), unpack(r["train"], np.uint8)
        c = np.concatenate([unpack(x["counts"], np.int64) for x in r["known"]])
        log_p1 = np.log10((c + 1) / (n + v + 1))
        before = np.empty_like(tokens)
        before[0] = np.searchsorted(vocab, END)
        before[1:] = tokens[:-1]
        base = np.add.reduceat(log_p1[tokens], bounds[:-1])
        lower = base + np.log10(1 - alpha) * np.add.reduceat((c[before] > 0).astype(np.int64), bounds[:-1])
        n_known = np.add.reduceat((c[tokens] > 0).astype(np.int64), bounds[:-1])
        # base results travel as the rows of a shard of their own kind
        yield batch_of(schema, [[-1 - int(r["chunk"] % 64)], [r["chunk"]], [pack(np.diff(bounds))], [pack(n_known)], [pack(base)], [pack(lower)], [b""]])
        code = before * len(vocab) + tokens
        order = np.argsort(code, kind="stable")
        held = code[order]
        new = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
        u, w = held[new] // len(vocab), held[new] % len(vocab)
        doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint32), np.diff(bounds))[order]
        many = np.diff(np.append(new, len(held)))
        counted = np.add.reduceat(train[doc].astype(np.int64), new)
        norm = np.round((np.log10(np.maximum(c[u], 1)) + log_p1[w] - _NORM_LOW) / _NORM_STEP)
        norm = np.clip(norm, 0, 65535).astype(np.uint16)
        key = (mix(vocab[u], np.uint64(1)) >> np.uint64(32) << np.uint64(32)) | (vocab[w] >> np.uint64(32))
        shard = (mix(vocab[u], (vocab[w] >> np.uint64(7)) % np.uint64(SPLIT) + np.uint64(2)) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        asked = c[u] > 0  # nothing follows a word that was never seen
        by = np.lexsort((key[asked], shard[asked]))
        at = np.flatnonzero(asked)[by]
        spread = np.repeat(new[at], many[at]) + np.arange(many[at].sum()) - np.repeat(np.cumsum(many[at]) - many[at], many[at])
        cut = np.searchsorted(shard[at], np.arange(shards + 1))
        ends = np.concatenate(([0], np.cumsum(many[at])))
        for s in np.flatnonzero(np.diff(cut)):
            x = at[cut[s]: cut[s + 1]]
            yield batch_of(schema, [[int(s)], [r["chunk"]], [pack_sorted(key[x])], [pack(many[x].astype(np.uint32))], [pack(counted[x].astype(np.uint32))], [pack(norm[x])],
                                    [pack(doc[spread[ends[cut[s]]: ends[cut[s + 1]]]])]])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        if group["shard"].iloc[0] < 0:
            return pd.DataFrame({"chunk": group["chunk"], "kind": 0, "a": group["keys"], "b": group["many"], "c": group["counts"], "d": group["norms"]})
        keys = [unpack_sorted(x) for x in group["keys"]]
        counted = np.concatenate([unpack(x, np.uint32) for x in group["counts"]])
        flat = np.concatenate(keys)
        taught = counted > 0
        pairs, first, at = np.unique(flat[taught], return_index=True, return_inverse=True)
        total = np.bincount(at, counted[taught], len(pairs))
        norm = np.concatenate([unpack(x, np.uint16) for x in group["norms"]])[taught][first] * _NORM_STEP + _NORM_LOW
        trie = Trie(pairs, np.log10(1 + alpha / (1 - alpha) * total / 10.0 ** norm))
        out = []
        for k, many, docs in zip(keys, group["many"], group["docs"], strict=True):
            gain = np.repeat(trie.gain(k), unpack(many, np.uint32))
            doc = unpack(docs, np.uint32)
            total = np.bincount(doc, gain)
            some = np.flatnonzero(total)
            out.append((pack(some.astype(np.uint32)), pack(total[some])))
        return pd.DataFrame({"chunk": group["chunk"], "kind": 1, "a": [a for a, _ in out], "b": [b for _, b in out], "c": None, "d": None})

    asked = chunks.select("chunk", "train", "bounds", "vocab", "often", "ranks").join(known, "chunk").mapInArrow(
        ask, "shard int, chunk long, keys binary, many binary, counts binary, norms binary, docs binary")
    answers = asked.groupBy("shard").applyInPandas(answer, "chunk long, kind int, a binary, b binary, c binary, d binary")

    def finish(key, group: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        base = group[group["kind"] == 0].iloc[0]
        score = unpack(base["d"], np.float64).copy()
        for _, r in group[group["kind"] == 1].iterrows():
            score[unpack(r["a"], np.uint32)] += unpack(r["b"], np.float64)
        head = heads.iloc[0]
        ids = pd.array([None if x is None or x != x else int(x) for x in head["ids"]], "Int64")
        return pd.DataFrame({"doc_id": ids, "held_out": unpack(head["train"], np.uint8) == 0, "n_tokens": unpack(base["a"], np.int64),
                             "n_known": unpack(base["b"], np.int64), "train_tokens": n, "base_score": unpack(base["c"], np.float64), "score": score})

    return answers.groupBy("chunk").cogroup(chunks.select("chunk", "ids", "train").groupBy("chunk")).applyInPandas(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
