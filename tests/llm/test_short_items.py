"""Benchmark items too short for an edit."""

import random

from tramline.llm import decontaminate


def test_short_items_are_matched_exactly(spark):
    rng = random.Random(4)
    items = [(1, "Name three primary colors"), (2, "a b"), (3, "A"), (4, "a b"), (5, " "), (6, None), (7, "b a c")]
    rows = [(100, "please name THREE primary\ncolors now"), (101, "name three primary"), (102, None), (103, ""), (104, "name three primary colours")]
    rows += [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))) for i in range(60)]
    want = set()
    for d, text in rows:
        w = (text or "").lower().split()
        for i, item in items:
            t = (item or "").lower().split()
            at = [k for k in range(len(w) - len(t) + 1) if t and w[k:k + len(t)] == t]
            if at:
                want.add((d, i, 0, at[0], len(t)))
    got = decontaminate.contaminations(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=3).collect()
    assert (100, 1, 0, 1, 4) in want and len(want) > 60
    assert sorted(map(tuple, got)) == sorted(want)
