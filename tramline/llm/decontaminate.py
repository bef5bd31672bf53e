"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

The CGK walk reads a word sequence with a pointer that stays or moves by one word, as a random bit of (step, word) says,
and writes the word it stands on at each of 3n steps.  Sequences a few edits apart fall back into step, so edit
distance becomes Hamming distance, and equal words at sampled steps become LSH keys.  ``WALKS`` walks with ``DRAWS``
samples of ``SAMPLED`` steps each give the target recall (measured in the tests) at the edit threshold.

Windows have the size of an item.  Within k edits of an n-word item one of its k + 1 equal blocks of words stands
unchanged, so only windows that hold such a block at its place in the item are embedded: the rest cannot be matches.
Colliding (window, item) pairs are verified by the word edit distance between the item and the best stretch of text
within k words around the window.

The benchmark is taken in blocks of at most ``BLOCK`` items (about; split by a hash), each sent to the tasks by itself: what is
broadcast has a bound, and the documents are read once per block.

Items too short for an edit (up to four words at 80 percent) are matched as exact word windows in the same pass, without embedding.

Defined cases: words are compared with A-Z lower-cased; null text, or text without a word, has no matches; equal items each
give a row; repeated documents each give theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Texts, batch_of, mix, slices, windows

WALKS, DRAWS, SAMPLED = 8, 8, 2
BLOCK = 5000


def edits_allowed(n: int, similarity_pct: int) -> int:
    return n * (100 - similarity_pct) // 100


def cgk(words: np.ndarray, length: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """[row, step]: the word written at each step of one walk over each row of ``words`` (0 past its length)."""
    rows, width = words.shape
    padded = np.concatenate((np.where(np.arange(width) < length[:, None], words, np.uint64(0)), np.zeros((rows, 1), np.uint64)), 1)
    at = np.zeros(rows, np.int64)
    line = np.arange(rows)
    out = np.empty((rows, steps), np.uint64)
    coins = padded
    for j in range(steps):
        if j % 64 == 0:
            coins = mix(padded, np.uint64(1 + walk * 1_000_003 + j))
        out[:, j] = padded[line, at]
        at = np.minimum(at + ((coins[line, at] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64), width)
    return out


def lsh_keys(words: np.ndarray, length: np.ndarray) -> np.ndarray:
    """[row, draw]: a key of each sample of steps; the steps drawn depend on the row's length only.

    A walk passes the end of n words at about step 2n; later steps say nothing and are not drawn.
    """
    spots = np.random.default_rng(0).random((WALKS, DRAWS, SAMPLED))
    keys = np.empty((len(words), WALKS * DRAWS), np.uint64)
    line = np.arange(len(words))
    for walk in range(WALKS):
        out = cgk(words, length, walk, 2 * words.shape[1])
        for draw in range(DRAWS):
            key = mix(length.astype(np.uint64) << np.uint64(16), np.uint64(walk * DRAWS + draw))
            for spot in spots[walk, draw]:
                key = mix(key, out[line, (spot * 2 * length).astype(np.int64)])
            keys[:, walk * DRAWS + draw] = key
    return keys


def edit_distances(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, end): least word edits between each row of ``items`` and any stretch of the same row of ``texts``."""
    rows, n = items.shape
    width = texts.shape[1]
    ramp = np.arange(width + 1, dtype=np.int32)
    above = np.zeros((rows, width + 1), np.int32)
    for i in range(n):
        now = np.empty_like(above)
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(above[:, 1:] + 1, above[:, :-1] + (items[:, i: i + 1] != texts))
        above = np.minimum.accumulate(now - ramp, 1) + ramp
    end = above.argmin(1)
    return above[np.arange(rows), end], end


class Items:
    """One block of the benchmark, prepared for the tasks."""

    def __init__(self, ids: list[int], texts: list[str], similarity_pct: int):
        words = Texts(pa.array(texts, pa.string()), lower=True)
        starts, ends, first = words.words()
        hashed = words.hashes(starts, ends)
        self.ids = np.array(ids, np.int64)
        self.words = [hashed[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.n = np.diff(first)
        self.similarity_pct = similarity_pct
        blocks: dict[int, list] = {}
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        self.exact: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # words: (fingerprints, items), where no edit is allowed
        for n in sorted({int(x) for x in self.n if x}):
            mine = np.flatnonzero(self.n == n)
            k = edits_allowed(n, similarity_pct)
            if not k:
                gram = windows(np.concatenate([self.words[i] for i in mine]), np.arange(0, n * len(mine) + 1, n), n)[1]
                self.exact[n] = np.sort(gram), mine[np.argsort(gram)]
                continue
            size = n // (k + 1)
            for i in mine:
                for b in range(k + 1):
                    part = self.words[i][b * size: (b + 1) * size]
                    blocks.setdefault(size, []).append((int(windows(part, np.array([0, size]), size)[1][0]), n, b * size))
            table = np.stack([self.words[i] for i in mine])
            keys.append(lsh_keys(table, np.full(len(mine), n)).ravel())
            owners.append(np.repeat(mine, WALKS * DRAWS))
        flat = np.concatenate(keys)
        order = np.argsort(flat)
        self.keys, self.owner = flat[order], np.concatenate(owners)[order]
        self.blocks = {}
        for size, rows in blocks.items():
            rows = sorted(set(rows))
            grams = np.array([r[0] for r in rows], np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[grams >> np.uint64(44)] = True
            self.blocks[size] = (seen, grams, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))

    def candidates(self, hashed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, row) of the windows that hold a block of an item at its place."""
        found = [np.zeros((0, 3), np.int64)]
        for size, (seen, grams, n, offset) in self.blocks.items():
            at, gram = windows(hashed, first, size)
            maybe = seen[gram >> np.uint64(44)]
            at, gram = at[maybe], gram[maybe]
            lo, hi = np.searchsorted(grams, gram, "left"), np.searchsorted(grams, gram, "right")
            at, which = _spread(at, lo, hi)
            row = np.searchsorted(first, at, "right") - 1
            found.append(np.stack((np.maximum(at - offset[which], first[row]), n[which], row), 1))
        return tuple(np.unique(np.concatenate(found), axis=0).T)

    def matches(self, texts: Texts) -> list[tuple[int, int, int, int, int]]:
        """(row, item, distance, first word, words) of the best match of each item in each row."""
        starts, ends, first = texts.words()
        hashed = texts.hashes(starts, ends)
        start, size, row = self.candidates(hashed, first)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, (grams, owner) in self.exact.items():
            at, gram = windows(hashed, first, n)
            at, which = _spread(at, np.searchsorted(grams, gram, "left"), np.searchsorted(grams, gram, "right"))
            found, once = np.unique(np.stack((np.searchsorted(first, at, "right") - 1, owner[which]), 1), axis=0, return_index=True)
            for (r, item), x in zip(found.tolist(), once, strict=True):
                best[r, item] = (0, int(at[x] - first[r]), n)
        for part in np.array_split(np.arange(len(start)), len(start) // 4096 + 1):
            if not len(part):
                continue
            width = int(size[part].max())
            got = lsh_keys(self._window(hashed, start[part], width, first[row[part] + 1]), size[part])
            lo, hi = np.searchsorted(self.keys, got.ravel(), "left"), np.searchsorted(self.keys, got.ravel(), "right")
            w, which = _spread(np.repeat(part, got.shape[1]), lo, hi)
            if not len(w):
                continue
            w, i = np.unique(np.stack((w, self.owner[which]), 1), axis=0).T
            for n in np.unique(size[w]):
                k = edits_allowed(int(n), self.similarity_pct)
                of = size[w] == n
                r, item = row[w[of]], i[of]
                begin = np.maximum(start[w[of]] - k, first[r])
                around = self._window(hashed, begin, n + 2 * k, first[r + 1])
                distance, end = edit_distances(np.stack([self.words[x] for x in item]), around)
                for x in np.flatnonzero(distance <= k):
                    last = int(begin[x] + end[x] - first[r[x]])
                    key = (int(r[x]), int(item[x]))
                    best[key] = min(best.get(key, (int(n) + 1, 0, 0)), (int(distance[x]), max(0, last - int(n)), int(n)))
        return [(r, i, *found) for (r, i), found in sorted(best.items())]

    @staticmethod
    def _window(hashed, begin, size, stop):
        """[window, word]: ``size`` words from each ``begin``; past ``stop`` a value that equals no word."""
        at = begin[:, None] + np.arange(size)
        return np.where(at < stop[:, None], hashed[np.minimum(at, len(hashed) - 1)], np.uint64(0))


def _spread(values, lo, hi):
    """``values`` repeated for each index of their ranges [lo, hi), and those indexes."""
    many = hi - lo
    out = np.repeat(values, many)
    return out, np.repeat(lo, many) + np.arange(len(out)) - np.repeat(np.cumsum(many) - many, many)


def contaminations(docs: DataFrame, benchmark: DataFrame, similarity_pct: int = 80, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, distance, first_word, n_words): where an item stands in a document within the edit threshold."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    blocks = max(1, -(-items.count() // block))
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "distance", "first_word", "n_words")])
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about ``block`` items
        known = Items([r.item_id for r in rows], [r.text for r in rows], similarity_pct)

        def search(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                hits = known.matches(Texts(part.column("text"), lower=True))
                if hits:
                    ids = part.column("doc_id").to_pylist()
                    rows = list(zip(*[(ids[r], known.ids[i].item(), d, a, n) for r, i, d, a, n in hits], strict=True))
                    yield batch_of(schema, [list(c) for c in rows])

        out = texts.mapInArrow(search, ", ".join(f"{c} long" for c in schema.names))
        found = out if found is None else found.unionByName(out)
    return found
