"""Source divergence, hard negatives and packing against plain versions, with nulls, ties, repeats and clashing names."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tramline.llm import divergence, hard_negatives, packing

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("byte_bpe_50k.json")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = "doc_id long, text string, lang string, source string, term string, n string, bin string, row string"


# --- source divergence ---------------------------------------------------------------------------------------------------

def divergence_by_hand(rows, min_docs, top):
    docs = [(r[2] or "", r[3] or "", TERM.findall((r[1] or "").translate(LOWER))) for r in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        found = collections.Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in found.items() if n >= min_docs)
        count = collections.defaultdict(collections.Counter)
        for _, source, words in mine:
            count[source].update(w for w in words if found[w] >= min_docs)
        weight = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        sources = sorted({d[1] for d in mine})
        q = weight(sum(count.values(), collections.Counter()))
        p = {s: weight(count[s]) for s in sources}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out |= {(lang, s, "pair", o, v, k + 1) for k, (v, o) in enumerate(pairs)} | {(lang, s, "term", t, v, k + 1) for k, (v, t) in enumerate(terms)}
    return out


def talk(seed, n):
    rng = random.Random(seed)
    voc = ["ab", "Éa", "cd-ef", "x1y", "ß", "日本", "Zed", "q\x00r", "l'eau", "ab"]
    rows = [(i, " ".join(rng.choice(voc[: rng.randint(1, 10)]) for _ in range(rng.randint(0, 12))), rng.choice(["en", "de", None, ""]),
             rng.choice(["s1", "s2", "é", None, "s3"]), "t", "n", "b", "r") for i in range(n)]
    return rows + [rows[0], rows[0], (None, None, "en", "no terms"[:2], "t", "n", "b", "r"), (7, "", "fr", "a", "t", "n", "b", "r"), (7, "12 .", "fr", "b", "t", "n", "b", "r")]


@pytest.mark.parametrize(("min_docs", "block"), [(10, 200_000), (1, 5), (1000, 5)])
def test_divergence_by_hand(spark, monkeypatch, min_docs, block):
    monkeypatch.setattr(divergence, "BLOCK_ROWS", block)
    rows = talk(min_docs, 150)
    found = divergence.source_divergence(spark.createDataFrame(rows, TEXTS).repartition(4), min_docs, 4)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == divergence_by_hand(rows, min_docs, 4)


def test_divergence_of_nothing_and_of_a_long_text(spark):
    assert divergence.source_divergence(spark.createDataFrame([], TEXTS)).count() == 0
    rows = [(1, "Ab " * 3_000_000 + "zz", "en", "a", *"tnbr"), (2, "ab cd", "en", "b", *"tnbr")]
    got = {tuple(r) for r in divergence.source_divergence(spark.createDataFrame(rows, TEXTS), 1).collect()}
    assert got == divergence_by_hand(rows, 1, 10)


def test_the_tokenizer_cuts_as_the_pattern():
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(0x80), rng.randrange(0x250), 0xA0, 0x3000])) for _ in range(40))
        assert divergence.term_counts(text.encode()) == collections.Counter(t.encode() for t in TERM.findall(text.translate(LOWER)))


def test_terms_are_numbered_within_a_slice_and_dealt_once(spark):
    texts = pa.array([b"left out", b"", b" One, two\x00one ", "\u00e9t\u00e9 two \u00c9".encode(), b"12 34", b"also left out"])[1:5]
    row, number, terms = divergence.term_numbers(texts)
    found = list(zip(row.tolist(), terms.take(pa.array(number)).to_pylist(), strict=True))
    assert found == [(1, b"one"), (1, b"two"), (1, b"one"), (2, "\u00e9t\u00e9".encode()), (2, b"two"), (2, "\u00c9".encode())]
    kept = divergence.kept_terms(spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string"), 1)
    assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


# --- hard negatives ------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, v string, shard string"


def negatives_by_hand(rows, every, low_pct=80, n_positives=5, n_negatives=5):
    rows = {(i, x, y) for i, x, y in ((i, tuple(v), y) for i, v, y, *_ in rows if i is not None and v is not None and y is not None
                                      and all(x is not None and math.isfinite(x) for x in v))}
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows]
    out = []
    for anchor in sorted({i for i, _, _ in rows if i % every == 0}):
        _, q, label = min((r for r in rows if r[0] == anchor), key=lambda r: (r[2], np.array(r[1], "<i4").tobytes()))
        scored = sorted((-sum(a * b for a, b in itertools.zip_longest(q, v, fillvalue=0)), i, y) for i, v, y in rows if i != anchor)
        for s, positive, _ in [r for r in scored if r[2] == label][:n_positives]:
            fits = [(t, i) for t, i, y in scored if y != label and low_pct * -s <= 100 * -t <= 100 * -s][:n_negatives]
            out += [(anchor, positive, k + 1, i, -s, -t) for k, (t, i) in enumerate(fits)]
    return sorted(out)


def vectors(seed, n, width=6):
    rng = random.Random(seed)
    heads = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(heads)], rng.randrange(3), "v", "s") for i in range(n)]
    rows += [rows[3], rows[10], rows[10], (n, rows[10][1], 1, "v", "s"), (n + 1, rows[10][1], 2, "v", "s")]  # repeats and ties
    rows += [(None, rows[0][1], 1, "v", "s"), (20, None, 1, "v", "s"), (n + 2, rows[1][1], None, "v", "s"), (n + 3, [], 1, "v", "s"),
             (n + 4, [None] * width, 0, "v", "s"), (n + 5, [math.nan] * width, 0, "v", "s"), (n + 6, [math.inf, 1.0], 0, "v", "s"),
             (n + 7, [1.0, 2.0], 0, "v", "s"), (10, [9.0] * width, 0, "v", "s")]
    return rows


@pytest.mark.parametrize(("codes", "shard_rows", "low_pct", "block"), [(4, 50, 80, 2_048), (32, 16_384, 80, 3), (1, 7, 20, 5), (3, 1000, 100, 2_048)])
def test_hard_negatives_by_hand(spark, monkeypatch, codes, shard_rows, low_pct, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", block)
    monkeypatch.setattr(hard_negatives, "READ_ROWS", 8)
    rows = vectors(codes, 300)
    usable = hard_negatives.usable_rows(spark.createDataFrame(rows, VECTORS).repartition(3))
    got = hard_negatives.hard_negatives(usable, F.col("vec_id") % 10 == 0, low_pct=low_pct, codes=codes, shard_rows=shard_rows, fit_rows=100)
    assert sorted(tuple(r) for r in got.collect()) == negatives_by_hand(rows, 10, low_pct)


def test_hard_negatives_of_large_numbers_and_of_nothing(spark):
    assert hard_negatives.hard_negatives(hard_negatives.usable_rows(spark.createDataFrame([], VECTORS)), F.col("vec_id") % 10 == 0).count() == 0
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-200_000, 200_000)) for _ in range(3)], i % 2, "v", "s") for i in range(60)]  # products beyond 2^53
    got = hard_negatives.hard_negatives(hard_negatives.usable_rows(spark.createDataFrame(rows, VECTORS)), F.col("vec_id") % 10 == 0, codes=3)
    assert sorted(tuple(r) for r in got.collect()) == negatives_by_hand(rows, 10)


def test_the_visit_falls_and_stops_early():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 2, (400, 8)) for c in (-300, -100, 100, 300)]).astype("<i4")
    books = hard_negatives.Codebooks(x.astype(float), 8, 4)
    import pandas as pd

    one, two = books.cells(x.astype(float))
    shard = hard_negatives.Shard(pd.DataFrame({"vec_id": np.arange(len(x)), "label": 0, "one": one, "two": two, "v": [r.tobytes() for r in x]}), books)
    q = x[0].astype(float)
    portions = list(shard.visit(q))
    assert sorted(np.concatenate([at for at, _ in portions])) == list(range(len(x)))
    assert all(a[1] >= b[1] for a, b in itertools.pairwise(portions))
    for k, (_, bound) in enumerate(portions[:-1]):
        assert max(shard.scores(at, q).max() for at, _ in portions[k + 1:]) <= bound
    read = []
    shard.visit = lambda q, visit=shard.visit: (read.append(len(p[0])) or p for p in visit(q))
    score, ids = shard.positives(0, 0, q, 5)
    assert sum(read) < len(x) and list(score) == sorted(shard.scores(np.flatnonzero(shard.ids != 0), q))[:-6:-1]


# --- packing -------------------------------------------------------------------------------------------------------------

def test_encoder_equals_the_tokenizer():
    plain = tokenizers.Tokenizer.from_file(MODEL)
    plain.encode_special_tokens = True
    with open(MODEL, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    rng = random.Random(3)
    parts = [*"ab1 .,'\n\tÉ×ß日", " ", "  ", "'s", "　", "\x85", "́", "​", "²", "€", "<|endoftext|>", "word", "Wört", "\U0001FAE0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["", " ", "x" * 3000 + " y", "a b " * 500]
    for a in range(0, len(texts), 500):
        part = texts[a: a + 500]
        for text, ids in zip(part, encoder.encode(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("items", [1 << 17, 8])
def test_packing_is_a_round_trip(spark, items):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "be", "Gamma,", "ünï", "12"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [(i, t, "en", "s", *"tnbr") for i, t in enumerate(texts + ["word " * 2000, "", None, "a"])]
    rows += [rows[5], rows[5], (None, "no id", "en", "s", *"tnbr"), (None, None, "en", "s", *"tnbr")]
    docs = spark.createDataFrame(rows, TEXTS).repartition(3)
    got = packing.pack_documents(docs, MODEL, length=64, items=items)
    pieces = got.collect()
    plain = tokenizers.Tokenizer.from_file(MODEL)
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        edges = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        want.update((doc_id, k, a, b - a, tuple(ids[a:b])) for k, (a, b) in enumerate(itertools.pairwise(edges)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in pieces) == want
    by_sequence = collections.defaultdict(list)
    for r in pieces:
        by_sequence[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _, _ in parts] == [sum(n for _, n, _ in parts[:k]) for k in range(len(parts))] and sum(n for _, n, _ in parts) <= 64
    if items > 1000:
        least = -(-sum(r.length for r in pieces) // 64)
        assert len(by_sequence) <= max(least + 2, 1.02 * least)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(got).collect()}
    assert whole == {s: b"".join(x for _, _, x in sorted(parts)) for s, parts in by_sequence.items()}


def test_packing_nothing_and_a_long_text(spark):
    assert packing.pack_documents(spark.createDataFrame([], TEXTS), MODEL).count() == 0
    long = spark.createDataFrame([(1, "word, and " * 600_000, "en", "s", *"tnbr")], TEXTS)
    got = packing.pack_documents(long, MODEL).agg(F.count("*").alias("n"), F.sum("length").alias("ids"), F.countDistinct("sequence_id").alias("s"), F.max("piece").alias("last")).first()
    assert got.ids == 600_000 * 3 + 2 and got.n == got.s == -(-got.ids // 1024) == got["last"] + 1


def test_best_fit_takes_the_fullest_bin_with_room():
    rng = np.random.default_rng(6)
    for _ in range(200):
        sizes = rng.integers(1, 33, rng.integers(0, 40))
        bins, offsets, fills = packing.best_fit(sizes, 32)
        room = []
        for k in np.argsort(-sizes, kind="stable"):
            fits = [r for r in room if r >= sizes[k]]
            if fits:
                room[room.index(min(fits))] -= sizes[k]
            else:
                room.append(32 - sizes[k])
        assert sorted(32 - fills) == sorted(room) and all(fills[b] == sizes[bins == b].sum() for b in range(len(fills)))


def test_encoder_keeps_the_words_met_first(monkeypatch):
    with open(MODEL, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    monkeypatch.setattr(packing, "MEMO", 20)
    texts = ["the of the, and\nthe of", None, "", "  two  spaces \n\n end ", "naïve été!\nvoilà 12,5 €", "x" * 70 + " " + "y" * 70 + " the",
             *(f"the of w{'abcdefghij'[k % 10] * (k // 10 + 1)} the," for k in range(40))]
    plain = encoder.tokenizer
    for _ in range(2):
        got = encoder.encode(pa.array(texts, pa.string()))
        assert got == [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert {"of", "the,"} <= encoder.memo.keys()
    encoder.encode(pa.array(["nothing known"]))
    assert len(encoder.memo) <= 12 and "of" in encoder.memo
