"""Licenses by name, competing places, and the alignment against plain versions."""

import itertools
import random

from tramline.llm import licenses

SENTENCES = {
    "Released under the BSD License.": ["BSD"],
    "Licensed under CC BY 4.0.": ["CC-BY-4.0"],
    "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"],
    "This work is licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0"],
    licenses.TEMPLATES["AGPL-3.0-header"]: ["AGPL-3.0-header"],
    licenses.TEMPLATES["CC-BY-4.0-notice"]: ["CC-BY-4.0-notice"],
    licenses.TEMPLATES["CC-BY-SA-4.0-notice"]: ["CC-BY-SA-4.0-notice"],
    licenses.TEMPLATES["LGPL-2.1-header"]: ["LGPL-2.1-header"],
    "Licensed under the MIT License, Version 2.0.": ["MIT"],
    "The album was released under the label of a friend. The license fee was small.": [],
    "Released under the MIT License. Licensed under the Apache License, Version 2.0.": ["Apache-2.0", "MIT"],
    "": [],
}


def test_a_text_gives_the_license_that_it_names(spark):
    docs = spark.createDataFrame(list(enumerate(SENTENCES)), "doc_id long, text string")
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert {k: sorted(got.get(k, [])) for k in range(len(SENTENCES))} == dict(enumerate(map(sorted, SENTENCES.values())))


def test_every_template_gives_itself(spark):
    rows = [(i, f"some words before {t} and after") for i, t in enumerate(licenses.TEMPLATES.values())]
    got = [(r.doc_id, r.license, r.coverage) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(i, name, 1.0) for i, name in enumerate(licenses.TEMPLATES)]


def test_a_text_longer_than_a_slice(spark):
    text = "word " * 1_200_000 + licenses.TEMPLATES["Apache-2.0-header"] + " word" * 100_000
    (r,) = licenses.scan(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, license string")).collect()
    assert (r.license, r.coverage, r.first_word) == ("Apache-2.0-header", 1.0, 1_200_000)


def lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for (i, x), (j, y) in itertools.product(enumerate(a), enumerate(b)):
        rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_alignment_is_increasing_and_full_where_words_are_unique_or_all_repeat():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = licenses.anchored(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(pairs))
        assert len(pairs) <= lcs(a, b)
        distinct = list(dict.fromkeys(a))
        assert len(licenses.anchored(distinct, list(dict.fromkeys(b)))) == lcs(distinct, list(dict.fromkeys(b)))
        twice = [x for x in a for _ in (0, 1)]
        assert len(licenses.anchored(twice, b + b)) == lcs(twice, b + b)


def test_overlapping_places_compete():
    place = lambda n, size, a, b, foreign, name: (n, size, a, b, foreign, name)
    best, worse, apart, other = place(10, 10, 5, 14, 0, "x"), place(9, 10, 8, 20, 2, "y"), place(8, 10, 30, 41, 2, "z"), place(9, 10, 6, 15, 0, "other")
    kin = dict.fromkeys("xyz", "one")
    assert licenses.winners([worse, other, apart, best], kin) == [best, other, apart]
    assert licenses.winners([place(5, 5, 0, 6, 2, "x"), place(5, 5, 0, 4, 0, "y")], kin) == [place(5, 5, 0, 4, 0, "y")]
