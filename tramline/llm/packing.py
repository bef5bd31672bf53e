"""Best-fit packing of tokenized documents into sequences of fixed length, residuals merged up a tree.

A document is its token ids and an end id.  Only a document longer than a sequence is cut, into whole sequences, with
what is left over as its first piece; whole pieces are sequences already.  The rest is packed:

* First round, inside the task that tokenizes: best fit by falling size over up to ``ITEMS`` pieces at a time.  Bins
  with at most ``slack`` tokens free are final.
* Further rounds: underfull bins are items of their own size, dealt by hash into groups of up to ``ITEMS`` and packed by
  best fit again; nearly full bins leave.  Rounds go on, with fewer groups each, until one group holds all that is left, or a
  round over several groups has merged less than one bin in a hundred; what is left then is final.

A group has a bounded number of items whatever the sizes, and no task sees the whole corpus unless it fits one group.
Best fit takes the fullest bin that still has room, found in a bit set of the free lengths in use.

Tokenizing: a space between two printable or word characters always begins a new pre-token of a byte-level BPE tokenizer
with the usual pattern, so texts are cut there, each different stretch is encoded once by ``tokenizers`` and its ids are
kept (a bounded memo).  Strings of special tokens in a text are ordinary text.

Defined cases: null or empty text is the end id alone.  Every row is a document of its own, rows with equal or null ids
too.  A text is tokenized whole, however long; a task must hold one text's ids.  Other columns are ignored.  An empty
table gives no rows.
"""

from __future__ import annotations

import os
import re
import sys
import types
from array import array
from collections import ChainMap, defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .words import batch_of, slices

ITEMS = 1 << 17  # pieces or bins that one best-fit round holds
MEMO = 1_200_000  # stretches remembered by a worker, some 200 bytes each
STRETCH = 64  # characters of the longest stretch that is remembered
CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
ENDS = re.compile(r"\A[!-~\w](?:.*[!-~\w])?\Z", re.DOTALL)
WORD = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)")
# fixed values: byte-level tokenizers write the printable bytes of Latin-1 as themselves, the others from U+0100 on
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
AS_CHARS = {b: chr(0x100 + k) for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers; ``model`` is a tokenizer file's content."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.memo: dict[str, bytes] = {}  # ids of a stretch with a space before it; its ends are printable
        self.marks: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}  # ids of what begins a text, without a space

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, chars: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(chars)]).tobytes()

    def _body(self, body: str) -> bytes:
        """The ids of letters with a space before them, from the memo or the model."""
        ids = self.memo.get(body)
        if ids is None:
            ids = self._word(AS_CHARS[32] + (body if body.isascii() else body.encode().decode("latin-1").translate(AS_CHARS)))
            if len(body) <= STRETCH:
                self.memo[body] = ids
        return ids

    def _lines(self, stretch: str) -> bytes | None:
        """The ids of words with marks after them, one to a line; None for anything else.

        A word, the marks after it and a line break are pre-tokens of their own, so each goes to the model itself.
        """
        out = []
        for k, line in enumerate(stretch.split("\n")):
            if not (word := WORD.fullmatch(line)):
                return None
            body, marks = word.groups()
            if k:
                out.append(self._mark(AS_CHARS[10]))
                out.append(self._word(body if body.isascii() else body.encode().decode("latin-1").translate(AS_CHARS)))
            else:
                out.append(self._body(body))
            if marks:
                out.append(self._mark(marks))
        return b"".join(out)

    def _mark(self, chars: str) -> bytes:
        if chars not in self.marks:
            self.marks = {**(self.marks if len(self.marks) < 1000 else {}), chars: self._word(chars)}
        return self.marks[chars]

    def _learn(self, stretches: Iterable[str]) -> dict[str, bytes]:
        """The ids of stretches that are not in the memo, which then has them but for the long ones."""
        known, rest = {}, []
        for s in stretches:
            if s.isalpha() and s.isascii():
                known[s] = self._body(s)
            elif (ids := self._lines(s)) is None:
                rest.append(s)
            else:
                known[s] = ids
                if len(s) <= STRETCH:
                    self.memo[s] = ids
        for s, ids in zip(rest, self._ids([f" {s}" for s in rest]), strict=True):
            known[s] = ids
            if len(s) <= STRETCH:
                self.memo[s] = ids
        return known

    def _starts(self, stretches: list[str]) -> list[bytes]:
        """The ids of what begins each text."""
        if len(self.firsts) > MEMO // 10:
            self.firsts = {}
        new = list(set(stretches).difference(self.firsts))
        firsts = dict(zip(new, self._ids(new), strict=True))
        self.firsts.update((s, ids) for s, ids in firsts.items() if len(s) <= STRETCH)
        firsts = ChainMap(firsts, self.firsts)
        return [firsts[s] for s in stretches]

    def _encode_cut(self, texts: list[str]) -> list[bytes]:
        """The ids of texts with stretches that do not begin and end in print: cut by the pattern."""
        cut = [CUT.split(text) for text in texts]
        known = self._learn({s for x in cut for s in x[1:]}.difference(self.memo))
        known = ChainMap(known, self.memo)
        return [first + b"".join(map(known.__getitem__, x[1:])) for first, x in zip(self._starts([x[0] for x in cut]), cut, strict=True)]

    def encode(self, texts: pa.Array | Iterable[str]) -> list[bytes]:
        """The ids of every text (null: none). Each different stretch of the texts is looked up once, and its ids are laid out by Arrow."""
        texts = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()), "")
        if len(texts) == 0:
            return []
        if len(self.memo) > MEMO:  # frequent stretches were met first
            self.memo = dict(islice(self.memo.items(), MEMO // 2))
        cut = pc.split_pattern(texts, " ")
        bounds, coded = np.array(cut.offsets), cut.values.dictionary_encode()
        starts, at, names = bounds[:-1], np.array(coded.indices), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.memo.get, names))
        new = [k for k, x in enumerate(ids) if x is None]
        odd, used = np.zeros(len(names), bool), np.zeros(len(names), bool)
        odd[[k for k in new if not ENDS.search(names[k])]] = True
        odd_rows = np.logical_or.reduceat(odd[at], starts)
        inner = np.repeat(~odd_rows, np.diff(bounds))
        inner[starts] = False
        used[at[inner]] = True
        new = np.array(new, np.int64)
        new = new[used[new]].tolist()
        known = self._learn([names[k] for k in new])
        for k in new:
            ids[k] = known[names[k]]
        plain = np.flatnonzero(~odd_rows)
        ids += self._starts([names[k] for k in at[starts[plain]].tolist()])
        at[starts[plain]] = len(names) + np.arange(len(plain))
        laid = pa.array(ids, pa.large_binary()).take(pa.array(at))
        edges = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset + bounds].tolist()
        data = memoryview(laid.buffers()[2] or b"")
        out = [bytes(data[a:b]) for a, b in zip(edges, edges[1:])]
        rows = np.flatnonzero(odd_rows).tolist()
        for k, x in zip(rows, self._encode_cut(texts.take(pa.array(rows, pa.int64())).to_pylist()), strict=True):
            out[k] = x
        return out


def worker_encoder(model: str) -> Encoder:
    """The encoder of this worker process, kept for its next tasks with what it has learned."""
    kept = sys.modules.setdefault("_tramline_worker_encoder", types.ModuleType("_tramline_worker_encoder")).__dict__
    if kept.get("model") != model:
        kept.update(model=model, encoder=Encoder(model))
    return kept["encoder"]


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of every item and the fill of every bin: by falling size into the fullest bin with room."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room, rooms, fills = defaultdict(list), 0, []
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = length, len(fills)
            fills.append(0)
        bins[k], offsets[k] = b, fills[b]
        fills[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins, offsets, np.array(fills, np.int64)


PIECES = "doc_id long, piece int, start long, length long, ids binary, bin long, offset long, fill long"


def cut_and_pack(docs: DataFrame, model: str, length: int, end_id: int, items: int = ITEMS) -> DataFrame:
    """The pieces of every document in the bins of their own task."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, spot = None, TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        held_bytes = 0

        def rows(pieces, bins, offsets, fills):
            doc, piece, start, ids = zip(*pieces, strict=True)
            return batch_of(schema, [list(doc), list(piece), list(start), [len(x) // 4 for x in ids], list(ids), bins + spot, offsets, fills])

        def packed():
            nonlocal held, held_bytes, spot
            if held:
                bins, offsets, fills = best_fit(np.array([len(x[3]) // 4 for x in held]), length)
                for a in range(0, len(held), 4096):
                    yield rows(held[a: a + 4096], bins[a: a + 4096], offsets[a: a + 4096], fills[bins[a: a + 4096]])
                spot += len(fills)
                held, held_bytes = [], 0

        for part in slices(batches):
            encoder = encoder or worker_encoder(model)
            whole = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text")), strict=True):
                n = len(ids) // 4 + 1
                first = (n - 1) % length + 1
                for piece in range(-(-n // length)):
                    a, b = max(0, first + (piece - 1) * length), first + piece * length
                    cut = ids[4 * a: 4 * b] + (end if b == n else b"")
                    (whole if b - a == length else held).append((doc, piece, a, cut))
                    if b - a < length:
                        held_bytes += len(cut)
                if len(whole) >= 4096:
                    yield rows(whole, np.arange(len(whole)), np.zeros(len(whole), np.int64), np.full(len(whole), length))
                    spot, whole = spot + len(whole), []
            if whole:
                yield rows(whole, np.arange(len(whole)), np.zeros(len(whole), np.int64), np.full(len(whole), length))
                spot += len(whole)
            if len(held) >= items or held_bytes > 256 << 20:
                yield from packed()
        yield from packed()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tokenize, PIECES)


def _packed_again(groups: int, length: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin")
        bins, offsets, fills = best_fit(group["fill"].to_numpy(np.int64), length)
        names = group["bin"].to_numpy(np.int64)
        head = np.zeros(len(fills), np.int64)
        at_start = offsets == 0
        head[bins[at_start]] = names[at_start]  # a merged bin is named by the item at its start
        return pd.DataFrame({"bin": names, "into": head[bins], "shift": offsets, "fill": fills[bins]})

    return pack


def merge_bins(open_bins: DataFrame, length: int, slack: int, items: int = ITEMS) -> DataFrame:
    """(bin, into, shift): where each underfull bin of the first round ends up."""
    at = stored(open_bins.select("bin", F.col("bin").alias("into"), F.lit(0).cast("long").alias("shift"), "fill"), "bins")
    live = at.select("into", "fill").distinct()
    before, turn = live.count(), 0
    while before > 1:
        groups, turn = -(-before // items), turn + 1
        step = stored(
            live.withColumn("group", F.pmod(F.xxhash64("into", F.lit(turn)), F.lit(groups))).withColumnRenamed("into", "bin")
            .groupBy("group").applyInPandas(_packed_again(groups, length), "bin long, into long, shift long, fill long"), "round")
        moved = step.select(F.col("bin").alias("old"), F.col("into").alias("new"), F.col("shift").alias("more"), F.col("fill").alias("now"))
        at = stored(at.join(moved, F.col("into") == F.col("old"), "left").select(
            "bin", F.coalesce("new", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"),
            F.coalesce("now", "fill").alias("fill")), "bins")
        live = step.select("into", "fill").distinct().where(F.col("fill") < length - slack)
        left = live.count()
        if groups == 1 or 100 * (before - left) < before:
            break
        before = left
    return at.select("bin", "into", "shift")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2, slack: int = 4, items: int = ITEMS) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): every piece with its ids and its place.

    ``tokenizer`` is the path of a tokenizer file that the driver can read; its content goes with the tasks.
    """
    with open(tokenizer, encoding="utf-8") as f:
        model = f.read()
    pieces = stored(cut_and_pack(docs, model, length, end_id, items), "pieces", codec="zstd")
    near_full = F.col("fill") >= length - slack
    moves = merge_bins(pieces.where(~near_full & (F.col("offset") == 0)).select("bin", "fill"), length, slack, items)
    shown = ["doc_id", "piece", "start", "length", "ids"]
    return (
        pieces.where(near_full).select(*shown, F.col("bin").alias("sequence_id"), "offset")
        .unionByName(pieces.where(~near_full).join(moves, "bin").select(*shown, F.col("into").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset")))
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves; each is bounded by the sequence length."""
    def joined(group: pd.DataFrame) -> pd.DataFrame:
        ids = b"".join(group.sort_values("offset")["ids"])
        return pd.DataFrame({"sequence_id": group["sequence_id"].iloc[:1].to_numpy(), "length": [len(ids) // 4], "ids": [ids]})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(joined, "sequence_id long, length long, ids binary")
