"""Quality rules on repetition within a text, by a suffix array over its words.

All words of a slice of documents are ranked by prefix doubling (word fingerprints salted with the row, so that
suffixes of different documents never tie); only suffixes that still tie are ranked further.  The ranks of all
levels give the longest common prefix of neighbours in the array, runs of these the prefix intervals, and the intervals
the maximal repeated substrings.  The rule limits the share of words that repeats of at least ``min_repeat`` words cover
and the length of the longest repeat.

Defined cases: null or empty text has no words and fails the base rule (fewer than ten words); every row is judged
by itself, so ties and repeated rows change nothing; null ``doc_id`` passes through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Texts, batch_of, mix, row_of, slices

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def suffix_array(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, levels): suffixes in order of ``keys``, and at level k the rank of each suffix by its first 2**k keys.

    A rank is the slot of the first suffix that ties with it.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = _first_slots(keys[order], np.arange(n))
    levels, step = [rank.astype(np.int32)], 1
    while True:
        held = rank[order]
        tied = np.zeros(n, bool)
        tied[1:] = held[1:] == held[:-1]
        tied[:-1] |= tied[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order, levels
        at = order[slots]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        pair = rank[at] * (n + 1) + after
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        order[slots] = at
        rank = rank.copy()
        rank[at] = _first_slots(pair, slots)
        levels.append(rank.astype(np.int32))
        step *= 2


def _first_slots(sorted_keys, slots):
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(new) else slots


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], at_least: int) -> np.ndarray:
    """lcp[i]: words that suffixes order[i - 1] and order[i] share, or 0 where that is fewer than ``at_least``."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    low = max(k for k in range(at_least.bit_length()) if 1 << k <= at_least)
    if low >= len(levels):
        return lcp
    held = levels[low][order]
    slot = np.flatnonzero(held[1:] == held[:-1]) + 1
    a, b = order[slot - 1], order[slot]
    long = np.zeros(len(slot), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = (a + long < n) & (b + long < n)
        same = fits & (levels[k][np.minimum(a + long, n - 1)] == levels[k][np.minimum(b + long, n - 1)])
        long[same] += 1 << k
    lcp[slot] = np.where(long >= at_least, long, 0)
    return lcp


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(length, first slot, last slot) of each prefix interval whose occurrences differ in the word before them."""
    before = np.where(order > 0, keys[order - 1], np.uint64(0)).tolist()
    live = np.flatnonzero(lcp)
    stack: list[list] = []  # [length, first slot, word before or None where it differs]
    done = -2
    for i, length in zip(live.tolist(), lcp[live].tolist(), strict=True):
        if i != done + 1:
            yield from _close(stack, 0, done, before)
        left, word = i - 1, before[i - 1]
        while stack and stack[-1][0] > length:
            top = stack.pop()
            if top[2] is None:
                yield top[0], top[1], i - 1
            left, word = top[1], top[2]
            if stack and stack[-1][0] >= length:
                _fold(stack[-1], word)
        if stack and stack[-1][0] == length:
            _fold(stack[-1], before[i])
        else:
            stack.append([length, left, word if word == before[i] else None])
        done = i
    yield from _close(stack, 0, done, before)


def _fold(entry, word):
    if word is None or entry[2] != word:
        entry[2] = None


def _close(stack, length, last, before):
    while stack:
        top = stack.pop()
        if stack:
            _fold(stack[-1], top[2])
        if top[2] is None:
            yield top[0], top[1], last


FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
          ("n_repeat_words", pa.int64()), ("covered_words", pa.int64()), ("longest_repeat", pa.int64()), ("n_maximal", pa.int64())]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _covered(at, length, n):
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: Texts, min_repeat: int) -> list[np.ndarray]:
    """The columns of ``FIELDS`` after ``doc_id``, one value for each row."""
    starts, ends, first = texts.words()
    n, rows = len(starts), texts.rows
    size = int(texts.offsets[-1])
    body = texts.buf[:size]
    head = (body & 0xC0) != 0x80
    ink = np.zeros(size + 1, np.int8)
    ink[starts] += 1
    ink[ends] -= 1
    chars = _per_row(head & (np.cumsum(ink[:size]) > 0), texts.offsets)
    symbols = _per_row(_SYMBOL[body], texts.offsets)

    l_start, l_end, l_first = texts.lines()
    with_word = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    l_row = row_of(l_first)[with_word]
    lines = mix(texts.hashes(l_start[with_word], l_end[with_word]), l_row.astype(np.uint64))
    distinct = np.unique(lines, return_index=True)[1]
    dup_lines = np.bincount(l_row, minlength=rows) - np.bincount(l_row[distinct], minlength=rows)

    row = row_of(first)
    keys = mix(texts.hashes(starts, ends), row.astype(np.uint64) + np.uint64(1))
    order, levels = suffix_array(keys)
    lcp = common_prefixes(order, levels, min(WINDOW, min_repeat))
    most = np.maximum(lcp, np.append(lcp[1:], 0)) if n else lcp  # of either neighbour: what the suffix repeats at most
    short, long = most >= WINDOW, most >= min_repeat
    repeat_words = _per_row(_covered(order[short], np.full(short.sum(), WINDOW), n), first)
    covered = _per_row(_covered(order[long], most[long], n), first)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, row[order[long]], most[long])
    maximal = np.zeros(rows, np.int64)
    for _, slot, _ in maximal_repeats(order, np.where(lcp >= min_repeat, lcp, 0), keys):
        maximal[row[order[slot]]] += 1
    return [np.diff(first), chars, symbols, dup_lines, repeat_words, covered, longest, maximal]


def repetition_rules(docs: DataFrame, min_repeat: int = 10, max_covered_pct: int = 15, max_longest: int = 100) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for each row of ``docs`` (columns ``doc_id`` and ``text``).

    A document is kept if it passes the base rule, repeats of at least ``min_repeat`` words cover at most
    ``max_covered_pct`` percent of its words and none is longer than ``max_longest`` words.
    """
    schema = pa.schema(FIELDS)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield batch_of(schema, [part.column("doc_id"), *measure(Texts(part.column("text")), min_repeat)])

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        rate, ", ".join(f"{n} long" for n, _ in FIELDS))
    return counted.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")).withColumn(
        "kept", F.expr(f"not base_failed and 100 * covered_words <= {max_covered_pct} * n_words and longest_repeat <= {max_longest}"))
