"""Each pipeline stage's rows against a plain version of its rule on a small corpus."""

import collections
import hashlib
import itertools
import math
import random
import zlib
from fractions import Fraction

from test_operators import corpus, words

from tramline.llm import stages
from tramline.llm.queries import SHARDS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, row string"


def keys(rows):
    return sorted((str(r[0]), str(r[1])) for r in rows)


def test_language_stage_by_walking_the_contexts(spark):
    rng = random.Random(6)
    letters = {"aa": "abcde", "bb": "bcdef", "cc": "cdefg"}
    rows = [(i, "".join(rng.choice(letters[g]) for _ in range(rng.randint(1, 12))), g) for i in range(60) for g in [rng.choice(sorted(letters))]]
    rows += [(70, "12 3", "aa"), (71, None, "aa"), (72, "", "bb"), (73, "zzz", None), (None, "abab", "aa"), rows[5]]
    seen = {g: collections.defaultdict(collections.Counter) for g in letters}
    for _, text, lang in {r for r in rows if r[2] and r[1] and zlib.crc32(str(r[0]).encode()) % 4 != 2}:
        t = b"\0" * 4 + text.encode()
        for p, k in itertools.product(range(4, len(t)), range(5)):
            seen[lang][k, t[p - k:p]][t[p]] += 1

    def bits(text, lang):
        t, out = b"\0" * 4 + text.encode(), 0.0
        for p in range(4, len(t)):
            for k in range(4, -1, -1):
                here = seen[lang].get((k, t[p - k:p]), {})
                total = sum(here.values()) + len(here)
                if t[p] in here:
                    out -= math.log2(here[t[p]] / total)
                    break
                out -= math.log2(len(here) / total) if here else 0
            else:
                out += 8
        return out

    want = []
    for r in rows:
        if any(x.isalpha() for x in r[1] or ""):
            cost = [bits(r[1], g) for g in letters]
            score = 1 / sum(2 ** -((c - min(cost)) * min(1, 20 / len(r[1]))) for c in cost)
            assert abs(score - stages.MIN_SCORE) > 1e-4
            if score >= stages.MIN_SCORE:
                want.append(r)
    assert 0 < len(want) < len(rows)
    got = stages.language_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), "")
    assert keys(got.collect()) == keys(want)


def test_decontamination_stage_by_edit_distances(spark, tmp_path):
    rng = random.Random(12)
    voc = [f"t{k}" for k in range(300)]
    items = [[rng.choice(voc) for _ in range(n)] for n in (2, 4, 5, 8, 12, 20, 30) for _ in range(3)]
    rows = []
    for d in range(120):
        w = [rng.choice(voc) for _ in range(rng.randint(0, 40))]
        if d % 2:
            item = list(rng.choice(items))
            for _ in range(rng.randint(0, len(item) // 3)):
                item[rng.randrange(len(item))] = "edited"
            w[len(w) // 2: len(w) // 2] = item
        rows.append((None if d % 10 == 9 else d // 2, " ".join(w)))
    rows += [(3, None), rows[1]]

    def stands(item, w):
        line = [0] * (len(w) + 1)
        for i, x in enumerate(item):
            new = [i + 1]
            for j, y in enumerate(w):
                new.append(min(line[j] + (x != y), line[j + 1] + 1, new[-1] + 1))
            line = new
        return min(line) <= len(item) // 5

    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [r for r in rows if not any(stands(t, words(r[1])) for t in items)]
    assert 50 < len(want) < len(rows) - 20
    got = stages.decontamination_stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path))
    assert keys(got.collect()) == keys(want)


def test_sharding_stage_by_the_law(spark):
    by = collections.defaultdict(list)
    for r in corpus():
        digest = hashlib.md5(f"shards:{'' if r[0] is None else r[0]}".encode()).hexdigest()
        by[r[3]].append((digest, r[1] or "", r))
    line = []
    for source, rows in by.items():
        for k, (digest, text, r) in enumerate(sorted(rows, key=lambda x: x[:2])):
            line.append((Fraction(2 * k + 1, 2 * len(rows)), "n" if source is None else "v" + source, digest, text, r))
    line.sort(key=lambda x: x[:4])
    want = []
    for spot, (*_, r) in enumerate(line):
        shard = spot * SHARDS // len(line)
        want.append((str(r[0]), str(r[1]), shard, spot - -(-shard * len(line) // SHARDS)))
    got = stages.sharding_stage(spark, spark.createDataFrame(corpus(), SCHEMA).repartition(5), "").collect()
    assert sorted((str(r.doc_id), str(r.text), r.shard, r.slot) for r in got) == sorted(want)
