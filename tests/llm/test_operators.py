"""Each operator against a brute-force version on small tables with nulls, empty texts, copies and clashing names."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tramline.llm import (
    decontaminate,
    language,
    licenses,
    line_dedup,
    mixing,
    near_dup,
    repetition,
    sharding,
    stages,
    toxicity,
    trie_lm,
)
from tramline.session import materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, row string"


def shuffle_files(spark):
    """Bytes by name of the shuffle files on the disk of this machine."""
    files, found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator(), {}
    while files.hasNext():
        f = files.next()
        if f.getName().startswith("shuffle_"):
            found[f.getName()] = f.length()
    return found


def words(text):
    return WORD.findall(text or "")


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    voc = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    texts = [" ".join(rng.choice(voc) for _ in range(rng.randint(1, 80))) for _ in range(n)]
    for k in range(12):  # near copies, lines repeated in and across documents
        w = texts[k].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], "", None, "  \t ", "one", "A b", "a B", "x y z\n\nx y z\nx y z", (voc[0] + " ") * 300]
    texts = [t if t is None or rng.random() < 0.5 else t + "\nShared Line\n  shared line " for t in texts]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(t or ""), 1, "r") for i, t in enumerate(texts)]
    return rows + [(None, "no id here", "en", "a", 5, 1, "r"), rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def repeats(w, size):
    """Words covered by repeats of ``size`` or more words, and the longest repeat, by all pairs."""
    covered, longest = set(), 0
    for i, j in itertools.combinations(range(len(w)), 2):
        n = 0
        while j + n < len(w) and w[i + n] == w[j + n]:
            n += 1
        if n >= size:
            covered |= set(range(i, i + n)) | set(range(j, j + n))
            longest = max(longest, n)
    return len(covered), longest


def test_repetition_by_all_pairs(docs):
    for r, text in repetition.repetition_rules(docs, min_repeat=7).join(docs.select("doc_id", "text").distinct(), "doc_id").rdd.map(lambda r: (r, r.text)).collect():
        w = words(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        covered, longest = repeats(w, 7)
        grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        five = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert (r.n_repeat_words, r.covered_words, r.longest_repeat) == (len(five), covered, longest)
        assert r.base_failed == (len(w) < 10 or 100 * len(five) > 20 * len(w))


def test_maximal_repeats_of_a_known_text():
    from tramline.llm.words import Texts

    texts = Texts(pa.array(["p a b c q a b c r a b s"]))
    starts, ends, _ = texts.words()
    keys = texts.hashes(starts, ends)
    order, levels = repetition.suffix_array(keys)
    lcp = repetition.common_prefixes(order, levels, 2)
    found = sorted((n, hi - lo + 1) for n, lo, hi in repetition.maximal_repeats(order, lcp, keys))
    assert found == [(2, 3), (3, 2)]  # "a b" three times, "a b c" twice


def test_line_dedup_by_counting(docs):
    rows = corpus()
    strip = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)
    met = collections.defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            met[strip(line)].add(r[0])
    gone = {k for k, v in met.items() if len(k) >= 1 and len(v) >= 3}
    assert gone
    want = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if strip(x) not in gone]
        want.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    first = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=3, policy="first"))
    # a repeated row shares its document's bitmap, so a first occurrence in one stays twice
    stay = sum(x[2] for x in want) - first.agg(F.sum("n_dropped")).first()[0]
    assert len(gone) <= stay <= len(gone) + 1
    assert line_dedup.sha256_hex("é") == hashlib.sha256("é".encode()).hexdigest()


def test_shards_match_the_mixture(docs):
    got = sharding.interleaved_shards(docs, 7).select("row.source", "row.doc_id", "shard", "slot").collect()
    assert len(got) == docs.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    total = collections.Counter(r.source for r in got)
    for v in by.values():
        for source, n in total.items():
            assert abs(sum(r.source == source for r in v) - n / 7) <= 2


def shares(budget, children):
    """children: (cap, weight) by name; water-filling by raising the level step by step."""
    out, left = {}, dict(children)
    while left:
        level = budget / max(1, sum(w for _, w in left.values()))
        full = {k: c for k, (c, w) in left.items() if c <= w * level}
        if not full:
            return out | {k: math.floor(w * level) for k, (_, w) in left.items()}
        for k, c in full.items():
            out[k] = c
            budget -= c
            left.pop(k)
    return out


def test_mixing_by_budgets(docs):
    weights = {"lang": {"en": 3, "de": 1}, "domain": {"x": 2}}
    got = mixing.mix_sources(docs, F.when(F.col("source") == "a", "x").otherwise("y"), weights, share=0.6, max_epochs=2).select(
        "row.doc_id", "row.lang", "row.source", "epoch", "n_tokens", "budget").collect()
    leaves = collections.Counter()
    for r in corpus():
        leaves["x" if r[3] == "a" else "y", r[2], r[3]] += len(words(r[1]))
    cap = lambda *p: sum(2 * v for k, v in leaves.items() if k[:len(p)] == p)
    plan, w = {}, lambda level, k: weights.get(level, {}).get(k, 1)
    for d, bd in shares(math.floor(sum(leaves.values()) * 0.6), {d: (cap(d), w("domain", d)) for d in {k[0] for k in leaves}}).items():
        for g, bg in shares(bd, {g: (cap(d, g), w("lang", g)) for g in {k[1] for k in leaves if k[0] == d}}).items():
            for s, bs in shares(bg, {s: (cap(d, g, s), 1) for s in {k[2] for k in leaves if k[:2] == (d, g)}}).items():
                plan[d, g, s] = bs
    used = collections.Counter()
    for r in got:
        leaf = ("x" if r.source == "a" else "y", r.lang, r.source)
        used[leaf] += r.n_tokens
        assert r.budget == plan[leaf]
    largest = max(len(words(r[1])) for r in corpus())
    for leaf, budget in plan.items():
        assert budget - largest < used[leaf] <= budget or leaves[leaf] == 0


def test_near_duplicates_by_all_pairs(docs):
    rows = [r for r in corpus() if r[0] is not None]
    sets = {}
    for i, text, *_ in rows:
        w = words((text or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            lo, hi = sorted((root[a], root[b]))
            root = {k: lo if v == hi else v for k, v in root.items()}
    assert len(set(root.values())) < len(root) - 5
    for r in near_dup.near_duplicate_components(docs, size=3, percent=80).collect():
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_large_family_is_compared_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 4)
    monkeypatch.setattr(near_dup, "TILE", (8, 16))
    rng = random.Random(3)
    base = [f"w{k}" for k in range(90)]
    rows, sets = [], {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
        sets[i] = {tuple(w[k:k + 4]) for k in range(len(w) - 3)}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            lo, hi = sorted((root[a], root[b]))
            root = {k: lo if v == hi else v for k, v in root.items()}
    got = near_dup.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=80).collect()
    assert {r.doc_id: r.component_id for r in got} == root


def test_a_family_of_unlike_texts_is_not_copied_for_its_comparison(spark, monkeypatch):
    """Short texts around one common sentence tie into one family; what it writes stays in proportion to its members."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    monkeypatch.setattr(near_dup, "TILE", (8, 16))
    rng = random.Random(5)
    common = [f"c{k}" for k in range(12)]
    texts = [common + [f"w{i}x{k}" for k in range(rng.randint(3, 6))] for i in range(600)]
    texts += [t[:-1] + ["end"] for t in texts[::40]]
    sets = [{tuple(t[k:k + 4]) for k in range(len(t) - 3)} for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(root[:], 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            old, new = sorted((root[a], root[b]))[::-1]
            root = [new if k == old else k for k in root]
    assert 10 <= len(texts) - len(set(root)) <= 15

    steps = []

    def seen(df, name):
        before = shuffle_files(spark)
        out = materialise(df, name)
        steps.append((name, sum(n for f, n in shuffle_files(spark).items() if f not in before)))
        return out

    monkeypatch.setattr(near_dup, "stored", seen)
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = near_dup.near_duplicate_components(rows, size=4, percent=80).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))
    assert "families" in [name for name, _ in steps] and max(n for _, n in steps) < 1_000_000


@pytest.mark.parametrize("n", [7, 40, 500, 3000])
def test_prefixes_and_sketches_keep_every_pair_at_the_threshold(spark, n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    rows, sets = [], []
    for i in range(24):
        left = base[rng.permutation(n)[: n - i * n // 80]]
        sets.append(np.unique(np.concatenate((left, rng.integers(0, 2**64, i * n // 120, dtype=np.uint64)))))
        rows.append((1, i, 100 + i, sets[-1].tobytes()))
    rest = near_dup._sketched(spark.createDataFrame(rows, "family long, doc_id long, component long, items binary").repartition(3)).cache()
    pairs = near_dup._met(rest, 80)
    met, close = ({(r.a, r.b) for r in x.collect()} for x in (pairs, near_dup._close(pairs, rest, 80)))
    rest.unpersist()
    want = set()
    for a, b in itertools.combinations(range(24), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            want.add((a, b))
    assert 0 < len(want) < 276 and want <= close <= met


def test_register_estimate():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**64, 3000, np.uint64))
    b = np.sort(np.concatenate((a[:2400], rng.integers(0, 2**64, 600, np.uint64))))
    regs = near_dup.registers([np.sort(a), b])
    j, _ = near_dup.estimate(regs[:1], regs[1:], np.array([3000.0]), np.array([3000.0]))
    assert abs(j[0] - 2400 / 3600) < 0.2


def test_decontamination_recall(spark):
    rng = random.Random(1)
    voc = [f"t{k}" for k in range(400)]
    items = [(i, " ".join(rng.choice(voc) for _ in range(rng.randint(10, 50)))) for i in range(40)] + [(99, None), (98, "too short")]
    rows, want = [], set()
    for d in range(300):
        i, text = items[rng.randrange(40)]
        w = text.split()
        for _ in range(rng.randint(0, len(w) // 5)):
            k = rng.randrange(len(w))
            w[k:k + rng.randint(0, 1)] = [f"e{rng.randrange(9)}"] if rng.random() < 0.7 else []
        pre = [rng.choice(voc) for _ in range(rng.randint(0, 30))]
        rows.append((d, " ".join(pre + w + pre)))
        truth, _ = decontaminate.edit_distances(np.array([text.split()]), np.array([pre + w + pre]))
        if truth[0] <= len(text.split()) // 5:
            want.add((d, i))
    rows += [(500, None), (501, ""), (502, " ".join(rng.choice(voc) for _ in range(500)))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=15).collect()}
    assert len(got & want) >= 0.95 * len(want)
    assert not [p for p in got if p[0] >= 500]


def test_language_held_out(spark):
    rng = random.Random(5)
    parts = {"aa": ["tion", "the", "ing", "and"], "bb": ["ung", "sch", "der", "keit"]}
    rows = [(i, " ".join("".join(rng.choice(parts[g]) for _ in range(2)) for _ in range(30)), g) for i in range(80) for g in [rng.choice(["aa", "bb"])]]
    rows += [(900, None, "aa"), (901, "123 456", "bb"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.row.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
    assert all(got[i].lang_pred == g for i, _, g in rows[:80]) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_code_lengths_by_walking_the_contexts():
    from tramline.llm.words import Texts

    train = {"x": ["abracadabra", "abra"], "y": ["banana band"]}
    trees = language.ContextTrees(train)
    got = trees.code_lengths(Texts(pa.array(["abrazban", "q"])))
    for col, lang in enumerate(trees.langs):
        seen = collections.Counter()
        for t in train[lang]:
            t = b"\0" * 4 + t.encode()
            for p, k in itertools.product(range(4, len(t)), range(5)):
                seen[t[p - k:p], t[p]] += 1
        for row, text in enumerate(["abrazban", "q"]):
            t, bits = b"\0" * 4 + text.encode(), 0.0
            for p in range(4, len(t)):
                for k in range(4, -1, -1):
                    here = {s: c for (ctx, s), c in seen.items() if ctx == t[p - k:p]}
                    total = sum(here.values()) + len(here)
                    if t[p] in here:
                        bits -= math.log2(here[t[p]] / total)
                        break
                    bits -= math.log2(len(here) / total) if here else 0
                else:
                    bits += 8
            assert abs(got[row, col] - bits) < 1e-3


def test_trie_scores_by_counting(docs):
    rows = corpus()
    tok = [(r[0], [*words((r[1] or "").translate(LOWER)), None]) for r in rows]
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    one, two = collections.Counter(), collections.Counter()
    for i, w in tok:
        if train(i):
            one.update(w)
            two.update(zip([None, *w[:-1]], w, strict=True))
    n, v = sum(one.values()), len(one)
    want = collections.defaultdict(list)
    for i, w in tok:
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10((one[x] + 1) / (n + v + 1) * (0.5 if one[u] else 1) + (0.5 * two[u, x] / one[u] if one[u] else 0)) for u, x in zip([None, *w[:-1]], w, strict=True))
        want[i].append((len(w), sum(one[x] > 0 for x in w), base, score))
    for r in trie_lm.trie_scores(docs, shard_items=50).collect():
        tokens, known, base, score = want[r.doc_id][0]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, not train(r.doc_id))
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 0.003 * tokens


def test_elias_fano_round_trip():
    values = np.unique(np.random.default_rng(2).integers(0, 10**9, 5000).astype(np.uint64))
    bits, low, high = trie_lm.EliasFano.encode(values, 10**9)
    ef = trie_lm.EliasFano(len(values), bits, low, high)
    assert (ef.find(values) == np.arange(len(values))).all()
    assert (ef.find(np.setdiff1d(values + np.uint64(1), values)) == -1).all()


def test_toxicity_chain(spark):
    rng = random.Random(9)
    voc = [f"n{k}" for k in range(50)]
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        rows.append((i, " ".join([rng.choice(voc) for _ in range(40)] + ([rng.choice(["idiot!", "Stupid", "moron"])] if bad else []))))
        if i < 200:
            labels.append((i, int(bad)))
    rows += [(900, None), (901, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(d, chain).collect()}
    assert all(got[i].toxic == (i % 5 == 0) for i in range(300)) and not got[900].toxic
    assert chain.names == ["personal", "contempt", "toxic"]
    none = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not any(r.toxic for r in toxicity.score(d, none).collect())


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT-notice"].split()
    rows = [(1, "noise " * 50 + " ".join([*mit[:20], "inserted", "words", *mit[25:]]) + " more noise"), (2, "Licensed under CC BY-NC 4.0.\nx\nLicensed under CC BY-NC 4.0."),
            (3, "the license by the work under general"), (4, None), (5, "")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "MIT-notice"), (2, "CC-BY-NC-4.0"), (2, "CC-BY-NC-4.0")]
    assert licenses.increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert repetition.repetition_rules(empty).count() == 0
    assert near_dup.near_duplicate_components(empty).count() == 0
    assert decontaminate.contaminations(empty, bench).count() == 0
    assert line_dedup.apply_bitmaps(empty, line_dedup.keep_bitmaps(empty)).count() == 0
    assert sharding.interleaved_shards(empty, 3).count() == 0
    assert mixing.mix_sources(empty, F.lit("x"), {}).count() == 0
    assert trie_lm.trie_scores(empty).count() == 0
    assert licenses.scan(empty).count() == 0
    assert language.identify(empty, language.fit(empty)).count() == 0


def test_stages_keep_the_columns(spark, docs, tmp_path):
    """The stages on documents with columns of clashing names."""
    spark.createDataFrame([(1, corpus()[20][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs.withColumns({"score": F.lit(0.5), "nth": F.lit(7), "epoch": F.lit("e")})
    counts = [now.count()]
    for name, stage in corpus_pipeline.STAGES:
        columns = now.columns
        out = stage(spark, now, str(tmp_path))
        want = [c for c in columns if c != "shard"] + ["shard", "slot"] if name == "shards" else columns
        assert out.columns == want
        now = spark.createDataFrame(out.collect(), out.schema)
        counts.append(now.count())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] <= counts[2] and counts[5] == counts[4]
    assert stages.MIN_SCORE < 0.5


def test_stages_without_ids(spark, tmp_path):
    """One row of each group stays in near dedup, that of the lowest ``doc_id``, null last; unlike texts of one id stay.

    Rows without ``doc_id`` go by their text in decontamination.
    """
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefgh") + rng.choice("klmnop") for _ in range(40))
    leak, clean, other = text(), text(), text()
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, leak), (None, clean), (None, clean), (None, None), (1, f"{leak} tail"), (2, clean), (2, clean), (2, other), (3, clean)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    near = stages.near_dup_stage(spark, d, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in near if r.doc_id is not None) == sorted([(1, f"{leak} tail"), (2, clean), (2, other)])
    assert [(r.doc_id, r.text) for r in near if r.doc_id is None] == [(None, None)]
    left = stages.decontamination_stage(spark, d, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted((i or 0, t or "") for i, t in rows if leak not in (t or ""))


def test_fits_take_repeated_rows_once(spark):
    rows = [(i, f"the thing and the other {i} idiot" if i % 2 else f"der Schein und die Zeit {i}", "bb" if i % 2 else "aa") for i in range(40)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hot = plain.unionByName(spark.createDataFrame([rows[1]] * 50, plain.schema))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    one, many = (toxicity.fit(d, labels) for d in (plain, hot))
    assert all(np.allclose(a, b) for a, b in zip(one.models, many.models, strict=True))
    big = 1 << 30  # everything is drawn
    assert all(np.array_equal(a, b) for a, b in zip(language.fit(plain, fit_bytes=big).costs, language.fit(hot, fit_bytes=big).costs, strict=True))


def test_every_language_is_learned(spark):
    """Documents larger than a language's share, and over 1 MiB, are cut for the fit; no language goes without one."""
    rows = [(i, f"{lang}{lang[::-1]} " * 12000, lang) for i in range(12) for lang in ("ab", "cd", "ef", "gh")] + [(99, "xyzzy " * 250_000, "xy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    trees = language.fit(docs, fit_bytes=40_000)
    assert trees.langs == ["ab", "cd", "ef", "gh", "xy"]
    got = language.identify(docs.select("doc_id", F.substring("text", 1, 60).alias("text"), "lang"), trees, keep=("lang",)).collect()
    assert len(got) == 49 and all(r.lang_pred == r.row.lang for r in got)


def test_sample_is_full_in_hash_order(spark, monkeypatch):
    """Shares are full to the byte where a language has the text, and whole where it has less."""
    met = {}
    monkeypatch.setattr(language, "ContextTrees", lambda samples: met.update(samples))
    rows = [(i, f"word{i} " * 50, "aa") for i in range(400)] + [(i, "kurz", "bb") for i in range(3)]
    rows += [rows[7]] * 500
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), modulus=1 << 30)
    assert (len(met["aa"]), len(met["bb"])) == (400, 3)
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), modulus=1 << 30, fit_bytes=0)
    assert sum(map(len, met["aa"])) == language.LEAST_BYTES and len(met["bb"]) == 3


def common(a, b):
    """Longest common subsequence, by the whole table."""
    line = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(line[j] + 1 if x == y else max(line[j + 1], new[-1]))
        line = new
    return line[-1]


def test_license_with_any_number_of_words_put_in(spark):
    far = " ".join(w + " filler" * 40 for w in "Licensed under the Apache License Version 2 0".split())
    rows = [(1, "Licensed under the terms and conditions of the Apache License, Version 2.0"), (2, far),
            (3, "Licensed under CC BY-NC 4. x Licensed under CC BY-NC 4.0. y " + far)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [
        (1, "Apache-2.0", 1.0, 0, 13), (2, "Apache-2.0", 1.0, 0, 288), (3, "Apache-2.0", 1.0, 15, 288),
        (3, "CC-BY-NC-4.0", 6 / 7, 0, 6), (3, "CC-BY-NC-4.0", 1.0, 7, 7)]


def test_license_scan_by_whole_alignment(spark):
    """Rows and coverages against the table of whole texts, no windows; every place holds what it says."""
    rng = random.Random(11)
    given = {"one": "a b c d e", "two": "b a b d f g a h", "three": "h g f e d c b a a b"}
    rows = [(i, " ".join(rng.choice("abcdefghxyz") for _ in range(rng.randint(0, 40)))) for i in range(250)]
    got = collections.defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), given, 80).collect():
        got[r.doc_id, r.license].append(r)
    hits = 0
    for (i, text), (name, template) in itertools.product(rows, given.items()):
        w, t = text.split(), template.split()
        found = sorted(got[i, name], key=lambda r: r.first_word)
        assert bool(found) == (100 * common(w, t) >= 80 * len(t))
        if len(found) == 1:
            assert found[0].coverage == common(w, t) / len(t)
        end = 0
        for r in found:
            assert r.first_word >= end
            end = r.first_word + r.n_words
            assert r.coverage >= 0.8 and common(w[r.first_word:end], t) == round(r.coverage * len(t))
            assert common(w[r.first_word + 1:end], t) < r.coverage * len(t)
        # as many places as fit side by side, by trying every end
        most, lo = 0, 0
        for hi in range(len(w) + 1):
            if 100 * common(w[lo:hi], t) >= 80 * len(t):
                most, lo = most + 1, hi
        assert len(found) == most
        hits += most
    assert hits > 50


def test_one_row_of_each_near_duplicate_group_stays(spark, docs, tmp_path):
    """Unlike texts of one ``doc_id`` stay, and so does one copy of every text, with and without ids."""
    rng = random.Random(8)
    a, b, c = (" ".join(rng.choice("abcdefgh") + rng.choice("klmnop") for _ in range(40)) for _ in range(3))
    a, b = max(a, b), min(a, b)
    rows = [(2, a), (2, b), (3, a), (None, c), (None, c), (None, f"{c} tail"), (None, b), (7, None), (8, "")]
    near = stages.near_dup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in near if r.text not in (c, f"{c} tail")) == sorted([(2, a), (2, b), (7, ""), (8, "")])
    assert len(near) == 5


def test_near_dup_stage_by_all_pairs(spark, docs, tmp_path):
    rows = sorted({(r[0], r[1]) for r in corpus()}, key=str)
    sets = []
    for _, text in rows:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    for x, y in itertools.combinations(root[:], 2):
        if sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
            old, new = root[y], root[x]
            root = [new if k == old else k for k in root]
    best = {}
    for k, r in enumerate(rows):
        best.setdefault(root[k], []).append(r[0])
    want = sorted((min(i for i in v if i is not None) if any(i is not None for i in v) else -1) for v in best.values())
    got = stages.near_dup_stage(spark, docs, str(tmp_path)).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == want
    assert len(want) < len(rows) - 5


def test_decontamination_by_row(spark, tmp_path):
    """A clean text stays though another of its ``doc_id`` holds an item."""
    leak, clean = (" ".join(f"{x}{k}" for k in range(20)) for x in "lc")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.createDataFrame([(2, leak), (2, clean), (None, leak), (None, clean), (3, None)], "doc_id long, text string")
    left = stages.decontamination_stage(spark, d, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == [(0, clean), (2, clean), (3, "")]
