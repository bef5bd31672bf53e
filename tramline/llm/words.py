"""Words, lines and 64-bit fingerprints of Arrow text columns, in numpy, a slice of rows at a time.

White space is ``[\\x20\\x09-\\x0D]``; none of these bytes occurs inside a longer UTF-8 sequence, so splitting
bytes splits text.  Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20  # text handled at once; one longer row makes a slice of its own

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S32, _S29 = np.uint64(32), np.uint64(29)


def mix(h, x):
    """One round of fingerprinting: folds ``x`` into ``h`` (both uint64 arrays or scalars)."""
    h = (h ^ x) * _K1
    h = (h ^ (h >> _S32)) * _K2
    return h ^ (h >> _S29)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that ``column`` holds at most ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class Texts:
    """The bytes of a text column: ``buf`` (eight spare zero bytes at the end) and row ``offsets``."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if column.null_count:
            column = pc.fill_null(column, "")
        column = column.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.buf = np.zeros(len(raw) + 8, np.uint8)
        self.buf[: len(raw)] = _LOWER[raw] if lower else raw
        self.offsets = offsets - offsets[0]
        self.rows = len(column)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first): byte spans of all words, and the index of each row's first word (rows + 1)."""
        n = int(self.offsets[-1])
        ink = ~_SPACE[self.buf[:n]]
        return self._runs(ink, n)

    def _runs(self, ink, n):
        before = np.zeros(n, bool)
        before[1:] = ink[:-1]
        after = np.zeros(n, bool)
        after[:-1] = ink[1:]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before[cuts] = False
        after[cuts - 1] = False
        starts = np.flatnonzero(ink & ~before)
        ends = np.flatnonzero(ink & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first) of all lines split at ``\\n``; an empty row has one empty line."""
        n = int(self.offsets[-1])
        breaks = np.flatnonzero(self.buf[:n] == 10)
        row = np.searchsorted(self.offsets, breaks, "right") - 1
        per_row = np.bincount(row, minlength=self.rows) + 1
        first = np.zeros(self.rows + 1, np.int64)
        np.cumsum(per_row, out=first[1:])
        starts = np.empty(first[-1], np.int64)
        ends = np.empty(first[-1], np.int64)
        opens = np.zeros(first[-1], bool)
        opens[first[:-1]] = True
        closes = np.zeros(first[-1], bool)
        closes[first[1:] - 1] = True
        starts[opens], ends[closes] = self.offsets[:-1], self.offsets[1:]
        starts[~opens], ends[~closes] = breaks + 1, breaks
        return starts, ends, first

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit fingerprint of each byte span."""
        eight = np.ndarray((len(self.buf) - 7,), "<u8", self.buf.data, strides=(1,))
        left = ends - starts
        out = mix(left.astype(np.uint64), eight[starts] & _MASK[np.minimum(left, 8)])
        live = np.flatnonzero(left > 8)
        at = starts[live]
        left = left[live]
        while len(live):
            at, left = at + 8, left - 8
            out[live] = mix(out[live], eight[at] & _MASK[np.minimum(left, 8)])
            more = left > 8
            live, at, left = live[more], at[more], left[more]
        return out


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word or line, from the index of each row's first."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(at, fingerprint) of every window of ``size`` words that lies within one row."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = np.ones(n - size + 1, bool)
    for k in range(1, size):
        cut = first[1:-1] - k
        whole[cut[(cut >= 0) & (cut < len(whole))]] = False
    gram = np.full(n - size + 1, np.uint64(size))
    for k in range(size):
        gram = mix(gram, hashes[k: k + n - size + 1])
    at = np.flatnonzero(whole)
    return at, gram[at]


def words_of(text: str | None) -> list[str]:
    """The words of one text, for small inputs and tests."""
    return [] if text is None else [w for w in text.translate(_TO_SPACE).split(" ") if w]


_TO_SPACE = {c: " " for c in range(0x09, 0x0E)}


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
