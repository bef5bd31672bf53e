"""Near-duplicate groups by HyperMinHash.

A document's set of word shingles is cut into ``REGISTERS`` parts by the top bits of a 64-bit fingerprint; each part
keeps the leading-zero count and ten mantissa bits of its smallest fingerprint (two bytes).  Four neighbouring
registers, empty ones filled from full ones, make a band; documents that agree on a band are candidates.  A candidate pair passes on when its
collision-corrected Jaccard estimate is within six standard deviations of the threshold, and is then confirmed on
full sets.

Large families never meet as pairs.  Equal sets are one class.  In a band's group of up to ``SMALL`` classes all pairs
are candidates; in a larger one every member is held against one hub, which is linear in the group.  The links found
become components.  Where large groups still hold several components, the classes they tie form a family, and the
members outside the family's largest component are held against all its members in tiles of fixed size, estimate
first and full sets after, so that no pair of different components is left out.

Defined cases: null or empty text has an empty set, linked with nothing; rows of one ``doc_id`` are one document; a
row without ``doc_id`` stands alone (null component, kept).  At a Jaccard value of exactly the threshold a pair with
over a hundred shingles misses all 32 bands with probability under 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored
from .words import Texts, batch_of, mix, slices, windows

REGISTERS, BAND = 128, 4
BANDS = REGISTERS // BAND
MANTISSA_BITS = 10
SMALL = 16
TILE = (4096, 4096)
COMMON_BITS = 18
_REST_BITS = 64 - REGISTERS.bit_length() + 1


def shingle_sets(texts: Texts, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle fingerprints of each row; a shorter row is one shingle, a row without words none."""
    starts, ends, first = texts.words()
    hashed = texts.hashes(starts, ends)
    at, gram = windows(hashed, first, size)
    cut = np.searchsorted(at, first)
    count = np.diff(first)
    sets = []
    for r in range(texts.rows):
        if count[r] >= size:
            s = np.sort(gram[cut[r]: cut[r + 1]])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif count[r]:
            g = np.uint64(count[r])
            for h in hashed[first[r]: first[r + 1]]:
                g = mix(np.array([g]), h)[0]
            s = np.array([g], np.uint64)
        else:
            s = np.zeros(0, np.uint64)
        sets.append(s)
    return sets


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 [row, register]: 0 for an empty part, else (leading zeros + 1, mantissa) of its smallest value."""
    edges = (np.arange(REGISTERS, dtype=np.uint64) << np.uint64(_REST_BITS))
    low = np.zeros((len(sets), REGISTERS), np.uint64)
    some = np.zeros((len(sets), REGISTERS), bool)
    for r, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        filled = np.diff(np.append(at, len(s))) > 0
        low[r, filled] = s[at[filled]]
        some[r] = filled
    rest = low & np.uint64((1 << _REST_BITS) - 1)
    length = np.frexp(rest.astype(np.float64))[1]
    shift = length - 1 - MANTISSA_BITS
    body = np.where(shift >= 0, rest >> np.maximum(shift, 0).astype(np.uint64), rest << np.maximum(-shift, 0).astype(np.uint64))
    mantissa = body & np.uint64((1 << MANTISSA_BITS) - 1)
    zeros = np.clip(_REST_BITS - length, 0, 61).astype(np.uint64)
    return np.where(some, ((zeros + np.uint64(1)) << np.uint64(MANTISSA_BITS)) | mantissa, np.uint64(0)).astype(np.uint16)


def filled_up(regs: np.ndarray) -> np.ndarray:
    """The registers with every empty one copied from a full one, tried in an order of its own that all rows share.

    So a band of a short text rests on four values like any other, not on the one shingle that fell into it.
    """
    out = regs.copy()
    part = np.arange(REGISTERS, dtype=np.uint64)
    rows = np.flatnonzero((regs > 0).any(1) & (regs == 0).any(1))
    for turn in range(64 * REGISTERS):
        if not len(rows):
            break
        source = regs[rows][:, (mix(part, np.uint64(turn + 1)) >> np.uint64(57)).astype(np.int64)]
        out[rows] = np.where(out[rows] == 0, source, out[rows])
        rows = rows[(out[rows] == 0).any(1)]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimate less expected chance matches, registers it rests on), row by row of two register arrays."""
    filled = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    ratio = n_a / np.maximum(n_b, 1)
    by_chance = 0.1699194871597391 * 2.0 ** -MANTISSA_BITS * ((a > 0) & (b > 0)).sum(1) * 4 * ratio / (1 + ratio) ** 2
    return (same - np.minimum(by_chance, same)) / np.maximum(filled, 1), filled


SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, full array<long>"


def _fours(regs: np.ndarray) -> pa.ListArray:
    longs = np.ascontiguousarray(regs).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, longs.size + 1, BANDS, dtype=np.int32)), pa.array(longs.ravel()))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """One row per document: set size, a 128-bit fingerprint of the set, and the registers as 32 longs of four
    (as they are, and filled up)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
                        ("bands", pa.list_(pa.int64())), ("full", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(Texts(part.column("text"), lower=True), size)
            regs = registers(sets)
            second = np.uint64(0x51ED270B9F8B1D35)
            a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            b = np.array([mix(s, second).sum(dtype=np.uint64) for s in sets], np.uint64)
            yield batch_of(schema, [part.column("doc_id"), np.array([len(s) for s in sets], np.int64), a.view(np.int64), b.view(np.int64),
                                    _fours(regs), _fours(filled_up(regs))])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, SIGNED)


def _plausible(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose corrected estimate does not rule out ``threshold``."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bands").alias(f"bands_{x}"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def keep(batches):
        for part in batches:
            if part.num_rows == 0:
                continue
            regs = [part.column(f"bands_{x}").flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, REGISTERS) for x in "ab"]
            n = [part.column(f"n_{x}").to_numpy(zero_copy_only=False).astype(float) for x in "ab"]
            j, filled = estimate(*regs, *n)
            ok = j >= threshold - 6 * np.sqrt(threshold * (1 - threshold) / np.maximum(filled, 1))
            ok &= np.minimum(*n) >= threshold * np.maximum(*n)  # else no sets of these sizes reach it
            yield batch_of(schema, [part.column("a").filter(pa.array(ok)), part.column("b").filter(pa.array(ok))])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(keep, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc_id, items): the sorted distinct fingerprints, eight bytes each, of the documents in ``wanted``."""
    schema = pa.schema([("doc_id", pa.int64()), ("items", pa.binary())])

    def items(batches):
        for part in slices(batches):
            sets = shingle_sets(Texts(part.column("text"), lower=True), size)
            yield batch_of(schema, [part.column("doc_id"), [s.tobytes() for s in sets]])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(rows.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(items, "doc_id long, items binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets satisfy 100 * intersection >= percent * union."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def confirm(batches):
        for part in batches:
            ok = []
            for x, y in zip(part.column("items_a"), part.column("items_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(ok, pa.bool_())
            yield batch_of(out, [part.column("a").filter(keep), part.column("b").filter(keep)])

    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("items").alias(f"items_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(confirm, "a long, b long").distinct()


def near_duplicate_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (columns ``doc_id`` and ``text``)."""
    signed = stored(signatures(docs, size), "signed")
    same = ["set_a", "set_b", "n_shingles"]
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("full").alias("full")), "classes")
    several = full.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    reps = classes.select(F.col("rep").alias("doc_id"), "n_shingles", "bands")
    bands = (
        classes.select(F.col("rep").alias("doc_id"), F.posexplode("full").alias("band", "four"))
        .select("doc_id", F.xxhash64("band", "four").alias("key"))
    )
    sized = bands.groupBy("key").agg(F.count("*").alias("n"), F.min_by("doc_id", F.xxhash64("doc_id", "key")).alias("hub")).where("n > 1")
    met = stored(bands.join(sized, "key"), "bands")
    few = met.where(F.col("n") <= SMALL).select("key", "doc_id")
    many = met.where(F.col("n") > SMALL).select("doc_id", "hub").distinct()

    # rows of one doc_id with different sets belong together
    member = stored(full.select("doc_id", *same).join(several, "doc_id").join(classes.drop("bands", "full"), same).select("doc_id", "rep"), "several")
    lowest = member.groupBy("doc_id").agg(F.min("rep").alias("low"))
    links = member.join(lowest, "doc_id").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    pairs = stored(_ordered(few.alias("l").join(few.alias("r"), "key").where("l.doc_id < r.doc_id"), "l.doc_id", "r.doc_id").unionByName(
        _ordered(many.where("doc_id <> hub"), "doc_id", "hub")).distinct(), "pairs")  # narrow steps, each a small plan
    pairs = stored(_plausible(pairs, reps, percent / 100), "plausible")
    sets = _sets(docs, many.select("doc_id").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))), size)
    links = stored(links.unionByName(_confirmed(pairs, sets, percent)), "confirmed")
    found = stored(components(links), "components")
    rest = stored(_families(many, found), "families")
    if not rest.isEmpty():
        rest = stored(_sketched(rest.join(sets, "doc_id")), "rest")
        pairs = stored(_close(_met(rest, percent), rest, percent), "close")
        links = stored(links.unionByName(_confirmed(pairs, rest, percent)), "confirmed")
        found = stored(components(links), "components")

    return (
        signed.join(classes.drop("bands", "full"), same, "left")
        .join(found, F.col("rep") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.when(F.col("rep").isNotNull() & F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
                .otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _ordered(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(F.col(x), F.col(y)).alias("a"), F.greatest(F.col(x), F.col(y)).alias("b"))


def _families(many: DataFrame, found: DataFrame) -> DataFrame:
    """(family, doc_id, component, minor): classes tied by large band groups, where they are still of several components.

    ``minor`` is false for the members of the family's largest component: no two of them need to meet.
    """
    tied = components(many.where("doc_id <> hub"), "doc_id", "hub").withColumnRenamed("component", "family")
    named = tied.join(found, "node", "left").select("family", F.col("node").alias("doc_id"), F.coalesce("component", "node").alias("component"))
    sizes = named.groupBy("family", "component").agg(F.count("*").alias("n"))
    split = sizes.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    return named.join(split.drop("parts"), "family").select("family", "doc_id", "component", (F.col("component") != F.col("main")).alias("minor"))


def _sketched(rest: DataFrame) -> DataFrame:
    """``rest`` with a parity sketch of each set: bit k tells if an odd number of fingerprints end in k, of four to eight bits a fingerprint."""
    cols = ["family", "doc_id", "component", "items"]
    schema = pa.schema([(c, pa.int64()) for c in cols[:3]] + [("items", pa.binary()), ("n", pa.int64()), ("sketch", pa.binary())])

    def sketch(batches):
        for part in slices(batches, "items"):
            values, n = _joined(part.column("items"))
            out = []
            for s in np.split(values, np.cumsum(n)[:-1]):
                bits = max(8, 4 << (len(s) - 1).bit_length())
                odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
            yield batch_of(schema, [*(part.column(c) for c in cols), n, out])

    return rest.select(*cols).mapInArrow(sketch, "family long, doc_id long, component long, items binary, n long, sketch binary")


def _close(pairs: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches do not rule the threshold out: two sets differ in as many elements as their sketches in bits, or more."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def keep(batches):
        for part in batches:
            n = part.column("n_a").to_numpy() + part.column("n_b").to_numpy()
            differ = np.zeros(len(n), np.int64)
            for k, pair in enumerate(zip(part.column("sketch_a").to_pylist(), part.column("sketch_b").to_pylist(), strict=True)):
                bits = 8 * min(map(len, pair))
                x, y = (_folded(int.from_bytes(s, "little"), 8 * len(s), bits) for s in pair)
                differ[k] = (x ^ y).bit_count()
            ok = pa.array((100 + percent) * differ <= (100 - percent) * n)
            yield batch_of(schema, [part.column("a").filter(ok), part.column("b").filter(ok)])

    side = lambda x: rest.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(keep, "a long, b long").distinct()


def _folded(sketch: int, have: int, bits: int) -> int:
    """The sketch of ``bits`` bits of the same set."""
    while have > bits:
        have //= 2
        sketch = (sketch ^ sketch >> have) & (1 << have) - 1
    return sketch


def _commonness(rest: DataFrame) -> np.ndarray:
    """How many fingerprints of the sets in ``rest`` share each value of the top ``COMMON_BITS`` bits: a constant size on the driver."""
    schema = pa.schema([("part", pa.int32()), ("n", pa.int64())])

    def count(batches):
        n = np.zeros(1 << COMMON_BITS, np.int64)
        for part in batches:
            if part.num_rows:
                n += np.bincount(_part_of(_joined(part.column("items"))[0]), minlength=len(n))
        at = np.flatnonzero(n)
        yield batch_of(schema, [at.astype(np.int32), n[at]])

    found = rest.select("items").mapInArrow(count, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(1 << COMMON_BITS, np.int64)
    common[found.column("part").to_numpy()] = found.column("n").to_numpy()
    return common


def _part_of(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - COMMON_BITS)).astype(np.int64)


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of all rows in one array, number of each row's) of a column of sets."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0]: ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data.view(np.uint64), np.diff(ends) // 8


def _prefixes(rest: DataFrame, common: np.ndarray, percent: int) -> DataFrame:
    """One row per fingerprint, named with its family, of the prefixes of the sets in ``rest``, rare ones first.

    ``place`` is its place in that order, ``behind`` how many of it and what follows end in each of eight values of their low bits,
    a byte each (null where one does not hold it).  The longer set of a pair that reaches the threshold shares one of its first
    ``n - ceil(t n) + 1`` with the first ``n - ceil(2 t n / (1 + t)) + 1`` (``lead``) of the other; the order is the same for all.
    """
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("place", pa.int64()),
                        ("lead", pa.bool_()), ("behind", pa.int64())])

    def first(batches):
        for part in slices(batches, "items"):
            values, n = _joined(part.column("items"))
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((values, common[_part_of(values)], row))
            place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            at = place <= (n + -percent * n // 100)[row]
            values = values[order]
            low = np.zeros((len(values) + 1, 8), np.int64)
            low[np.arange(1, len(low)), (values & np.uint64(7)).astype(np.int64)] = 1
            low = np.cumsum(low, axis=0)
            behind = low[np.cumsum(n)[row[at]]] - low[:-1][at]
            packed = pa.array((behind << (8 * np.arange(8))).sum(1), mask=(behind > 255).any(1))
            row, place, values = row[at], place[at], values[at]
            family, doc, component = (part.column(c).to_numpy()[row] for c in ("family", "doc_id", "component"))
            key = mix(values, family.astype(np.int64).view(np.uint64)).view(np.int64)
            yield batch_of(schema, [key, doc, component, n[row], place, place <= (n + -2 * percent * n // (100 + percent))[row], packed])

    return rest.select("family", "doc_id", "component", "items").mapInArrow(
        first, "key long, doc_id long, component long, n long, place long, lead boolean, behind long")


def _met(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one family and different components whose full sets may reach the threshold; no other pair does.

    They share a fingerprint of their prefixes at places that leave enough behind.  In the group of a fingerprint the
    members outside its largest component are held against all, in tiles of a fixed number of narrow rows.
    """
    rows = stored(_prefixes(rest, _commonness(rest), percent), "prefixes")
    sized = (
        rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key")
        .agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main")).where("n > most")
        .select("key", "main", F.ceil((F.col("n") - F.col("most")) / TILE[0]).alias("rows"), F.ceil(F.col("n") / TILE[1]).alias("cols"))
    )
    turn = F.xxhash64("doc_id")
    placed = stored(
        rows.join(sized, "key").select("key", "doc_id", "component", "n", "place", "lead", "behind", (F.col("component") != F.col("main")).alias("minor"),
                                       F.pmod(turn, F.col("rows")).alias("row"), F.pmod(turn, F.col("cols")).alias("col"), "rows", "cols"), "placed")
    cols = ["key", "doc_id", "component", "n", "place", "lead", "behind", "minor"]
    left = placed.where("minor").select(*cols, "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    right = placed.select(*cols, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "col")
    left, right = (side.select(*[F.col(c).alias(c if c in ("key", "row", "col") else f"{c}_{x}") for c in side.columns]) for x, side in (("x", left), ("y", right)))
    shared = " + ".join(f"least(shiftright(behind_x, {k}) & 255, shiftright(behind_y, {k}) & 255)" for k in range(0, 64, 8))
    pairs = left.join(right, ["key", "row", "col"]).where(f"""
        component_x <> component_y and (not minor_y or doc_id_x < doc_id_y)
        and if(n_x < n_y or n_x = n_y and doc_id_x < doc_id_y, lead_x, lead_y)
        and 100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)
        and {100 + percent} * least(n_x - place_x, n_y - place_y) >= {percent} * (n_x + n_y)
        and coalesce({100 + percent} * ({shared}) >= {percent} * (n_x + n_y), true)""")
    return stored(_ordered(pairs, "doc_id_x", "doc_id_y").distinct(), "pairs")
