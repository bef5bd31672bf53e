"""How far the sources of a language differ in their words: term frequencies by a translate-table tokenizer.

``bytes.translate`` lowers A-Z and turns every separator into a blank in one pass over a slice of documents; Arrow cuts
the terms at blanks and numbers them, and sorted numbers give the frequencies of the slice's groups, which leave the
task.  Spark sums the rest, dealt by term.  Terms are runs of ASCII letters and of bytes from 0x80, so cutting bytes cuts text.

A language keeps the terms found in ``min_docs`` of its documents.  A group is a (lang, source); with ``V`` kept terms
and ``N`` occurrences of them in the group, a term's weight is ``1 + floor(SCALE * (count + 2) / (N + 2 * V))``, and two
weights p, q differ by ``floor((p - q)^2 / (p + q))``.  All of it is whole numbers.

Only terms that occur are stored.  The divergence of two sources is the sum over all kept terms, split in four:
every term as if in neither source, corrected by the terms of the one, by the terms of the other, and by the terms in
both.  The first three follow from each source's number of terms per weight; the last one is summed over blocks of terms,
of bounded size, in numpy, and a block gives one partial sum per pair of sources that meet in it.

Defined cases: null text, lang or source count as ''.  Every row is a document of its own, repeated rows too.  A group
without terms has N = 0; where V = 0 all divergences are 0.  Ties in value go by the item's UTF-8 bytes.  A text is read
whole at any length and other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .words import slices

SCALE = 1_000_000_000
SLICE = 8 << 20  # bytes of text whose counts are summed in the task
BLOCK_ROWS = 200_000  # (term, source) rows that one block of terms holds, about

# lower letters for A-Z, letters and bytes from 0x80 as they are, a blank for everything else
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number) of every occurrence of a term in binary texts without nulls, and the terms by number."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[offsets[0]: offsets[-1]]
    lowered = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(bytes(data).translate(TABLE))])
    cut = pc.split_pattern(lowered, " ")
    coded = cut.values.dictionary_encode()
    number = np.array(coded.indices, np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(np.array(cut.offsets)))
    full = (np.array(pc.binary_length(coded.dictionary)) > 0)[number]
    return row[full], number[full], coded.dictionary


def term_counts(text: bytes) -> Counter:
    """The terms of one document and how often each occurs, for small inputs and tests."""
    _, number, terms = term_numbers(pa.array([text], pa.binary()))
    return Counter(terms.take(pa.array(number)).to_pylist())


def _texts_as_empty(docs: DataFrame, *columns: str) -> list:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]


def group_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group, summed per slice."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            row, number, terms = term_numbers(part.column("text"))
            groups: dict = {}
            keys = zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)
            group = np.array([groups.setdefault(key, len(groups)) for key in keys], np.int64)
            v = len(terms)
            spots, n = np.unique(group[row] * v + number, return_counts=True)
            once = np.unique(row * v + number)  # a term of a document counts once
            found = np.unique(group[once // v] * v + once % v, return_counts=True)[1]
            lang, source = (pa.array(names, pa.string()) for names in zip(*groups, strict=True))
            for a in range(0, len(spots), 100_000):
                g, t = (pa.array(x) for x in np.divmod(spots[a: a + 100_000], v))
                yield pa.RecordBatch.from_arrays(
                    [lang.take(g), source.take(g), terms.take(t).cast(pa.binary()), pa.array(n[a: a + 100_000], pa.int64()),
                     pa.array(found[a: a + 100_000], pa.int64())], schema=schema)

    rows = docs.select(*_texts_as_empty(docs, "lang", "source"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(count, "lang string, source string, term binary, n long, docs long").select(
        "lang", "source", F.col("term").cast("string").alias("term"), "n", "docs")


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, n, found): one row per kept term, ``found`` lists (source, n) of the sources it occurs in.

    Slices are summed already, so rows are dealt once, by term, for both sums.
    """
    by_group = group_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (
        by_group.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("found"))
        .where(F.col("docs") >= min_docs).select("lang", "term", "n", "found")
    )


def weight(n, total, terms):
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)) in whole numbers of up to 38 digits."""
    top = F.expr(f"cast({SCALE} as decimal(10,0))") * (n + F.lit(2)).cast("decimal(19,0)")
    below = (total + 2 * terms).cast("decimal(19,0)")
    return (F.lit(1) + F.call_function("div", top, below)).cast("long")


def apart(p, q):
    """floor((p - q)^2 / (p + q)); weights stay below 2^30, their squared difference below 2^60."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p, q):
    return (p - q) * (p - q) // (p + q)


def _groups(docs: DataFrame, kept: DataFrame, occurring: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per (lang, source): terms, total, p0 (the weight of a term that is not there); per lang: terms, lang_total."""
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    totals = occurring.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = docs.select(*_texts_as_empty(docs, "lang", "source")).distinct()
    groups = (
        every.join(totals, ["lang", "source"], "left").join(langs.drop("lang_total"), "lang", "left")
        .select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total"))
        .withColumn("p0", F.when(F.col("terms") > 0, weight(F.lit(0), F.col("total"), F.col("terms"))))
    )
    return groups, langs


def _both_sides(rows: Iterator) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and the sums of their values, from (codes, values) arrays; compacted as they come."""
    codes, values, held = [], [], 0
    for c, v in rows:
        codes.append(c)
        values.append(v)
        held += len(c)
        if held > 4 * BLOCK_ROWS:
            codes, values = ([x] for x in _summed(codes, values))
            held = len(codes[0])
    return _summed(codes, values)


def _summed(codes: list, values: list) -> tuple[np.ndarray, np.ndarray]:
    code, value = np.concatenate(codes), np.concatenate(values)
    order = np.argsort(code, kind="stable")
    code, value = code[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(value, first) if len(first) else value


def _shared_terms(group: pd.DataFrame) -> pd.DataFrame:
    """What the terms in both of two sources add to the sum of the three parts, per pair of sources of one block."""
    group = group.sort_values(["term", "source"], kind="stable")
    source, names = pd.factorize(group["source"], sort=True)
    term = pd.factorize(group["term"])[0]
    p, p0 = group["p"].to_numpy(np.int64), group["p0"].to_numpy(np.int64)
    k = len(names)

    def pairs():
        yield np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = 1
        while True:  # each row with the one so many places on, while some term has as many sources
            at = np.flatnonzero(term[step:] == term[:-step]) if step < len(term) else np.zeros(0, np.int64)
            if not len(at):
                return
            a, b = at, at + step
            yield source[a] * k + source[b], _apart(p[a], p[b]) - _apart(p[a], p0[b]) - _apart(p0[a], p[b]) + _apart(p0[a], p0[b])
            step += 1

    code, value = _both_sides(pairs())
    names = np.asarray(names, dtype=object)
    return pd.DataFrame({"lang": group["lang"].iloc[0], "source": names[code // k] if k else [], "item": names[code % k] if k else [], "value": value})


def source_divergence(docs: DataFrame, min_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence from every other source, and the terms that stand out most."""
    kept = stored(kept_terms(docs, min_docs), "terms")
    occurring = kept.select("lang", "term", F.inline("found"))
    groups, langs = _groups(docs, kept, occurring)
    groups, langs = stored(groups, "groups"), stored(langs, "langs")
    weighed = stored(
        occurring.join(groups, ["lang", "source"])
        .select("lang", "source", "term", weight(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "p0"), "weighed")

    # terms above their language's weight
    spread = kept.join(langs, "lang").select("lang", "term", weight(F.col("n"), F.col("lang_total"), F.col("terms")).alias("q"))
    p, q = F.col("p"), F.col("q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        weighed.join(spread, ["lang", "term"]).where(p > q)
        .select("lang", "source", F.col("term").alias("item"), apart(p, q).alias("value"))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)
    )

    # every pair as if no term were in both
    shape = weighed.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("shape"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "p0")).alias("others"))
    none = F.array().cast("array<struct<p:bigint,n:bigint>>")
    faced = (
        groups.join(shape, ["lang", "source"], "left").join(others, "lang")
        .select("lang", "source", "terms", "p0", F.coalesce("shape", none).alias("shape"), F.explode("others").alias("o"))
        .where(F.col("o.source") != F.col("source"))
    )
    base = apart(F.col("p0"), F.col("o.p0"))
    own = F.aggregate("shape", F.lit(0).cast("long"), lambda s, x: s + x["n"] * (apart(x["p"], F.col("o.p0")) - base))
    empty = F.col("terms") == 0
    faced = stored(faced.select("lang", "source", F.col("o.source").alias("item"), F.when(empty, 0).otherwise(own).alias("own"),
                                F.when(empty, 0).otherwise(F.col("terms") * base).alias("base")), "faced")
    blocks = F.lit(max(1, -(-weighed.count() // BLOCK_ROWS)))
    shared = weighed.groupBy("lang", F.pmod(F.xxhash64("term"), blocks).alias("block")).applyInPandas(
        lambda group: _shared_terms(group), "lang string, source string, item string, value long")
    turned = lambda df, v: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col(v).alias("value"))
    summed = (
        faced.select("lang", "source", "item", (F.col("own") + F.col("base")).alias("value")).unionByName(turned(faced, "own"))
        .unionByName(shared).unionByName(turned(shared, "value"))
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )
    pairs = summed.withColumn("rank", F.row_number().over(best))
    shown = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*shown).unionByName(terms.withColumn("part", F.lit("term")).select(*shown))
