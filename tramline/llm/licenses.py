"""License scans by patience alignment.

A place is a stretch of text that may give a license: read from the left, it ends at the first word with which enough of a
template's words stand in the template's order, starts as late as that allows, and is widened into the free text up to its
neighbours as long as that takes in more of the template.  Any number of other words may stand between.  Places are sought only in
rows that hold enough words of the template, each counted as often as the template has it: no other row can reach the coverage.

A place is aligned with its template by anchors: words that occur once in the place and once in the template, of which the longest
increasing subsequence is kept; the gaps between them are aligned in the same way, with the words that are unique there, and a gap
without such words by patience sorting of all its words.  Where repeated words mislead the anchors, so that they align fewer words than
stand in order, the whole place is aligned like such a gap.  Coverage is the share of the template's words that are aligned.

A license has its name: words without which a text does not give it (``NAMES``), and words that make it another one
(``OTHERS``); a place without the former, or with one of the latter, is none.  Overlapping places of one family (``FAMILIES``) compete:
the higher coverage stays, then the one with fewer foreign words, then the longer template.

Defined cases: words are runs of ASCII letters and digits or other UTF-8 bytes, A-Z lower-cased, so punctuation and line
breaks do not matter; null or empty text has no rows, nor has an empty table; repeated documents each give theirs; a text is read
whole at any length, and other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Texts, batch_of, slices

# fixed values: notices by which public licenses are given
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD": "Released under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."),
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "BSD-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."),
    "BSL-1.0-header": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "ISC-notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Unlicense-notice": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "Zlib-notice": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
}


# fixed values: words that a text must have to give the license, and words that make it another license
NAMES = {
    "Apache-2.0": "apache 2", "CC-BY-NC-4.0": "cc by nc 4", "GPL-3.0": "gnu general 3", "MIT": "mit", "AGPL-3.0": "affero 3", "BSD": "bsd", "CC-BY-4.0": "cc by 4",
    "Apache-2.0-header": "apache 2", "AGPL-3.0-header": "affero", "BSD-notice": "redistributions disclaimer", "BSL-1.0-header": "boost", "CC-BY-4.0-notice": "attribution 4",
    "CC-BY-SA-4.0-notice": "sharealike 4", "CC0-1.0-notice": "waived", "GPL-3.0-header": "gnu general 3", "ISC-notice": "fee", "LGPL-2.1-header": "lesser",
    "MIT-notice": "sublicense", "MPL-2.0-header": "mozilla", "Unlicense-notice": "unencumbered", "Zlib-notice": "misrepresented",
}
OTHERS = {
    "GPL-3.0": "affero lesser library", "GPL-3.0-header": "affero lesser", "CC-BY-4.0": "nc sa nd", "CC-BY-4.0-notice": "sharealike noncommercial noderivatives",
    "CC-BY-NC-4.0": "sa nd", "CC-BY-SA-4.0-notice": "noncommercial",
}


FAMILIES = {
    "Apache-2.0": "Apache", "Apache-2.0-header": "Apache", "CC-BY-4.0": "CC", "CC-BY-NC-4.0": "CC", "CC-BY-4.0-notice": "CC", "CC-BY-SA-4.0-notice": "CC", "CC0-1.0-notice": "CC",
    "GPL-3.0": "GPL", "GPL-3.0-header": "GPL", "AGPL-3.0": "GPL", "AGPL-3.0-header": "GPL", "LGPL-2.1-header": "GPL", "MIT": "MIT", "MIT-notice": "MIT", "ISC-notice": "MIT",
    "BSD": "BSD", "BSD-notice": "BSD",
}


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, index of each row's first) of the words described above."""
    texts = Texts(column, lower=True)
    n = int(texts.offsets[-1])
    body = texts.buf[:n]
    starts, ends, first = texts._runs((body >= 128) | ((body >= 97) & (body <= 122)) | ((body >= 48) & (body <= 57)), n)
    return texts.hashes(starts, ends), first


def increasing(places: Sequence[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, p in enumerate(places):
        k = bisect.bisect_left(tops, p)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(p)
            piles.append(i)
        else:
            tops[k], piles[k] = p, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def grown(steps: Iterable[Sequence[int]], want: int | None = None) -> tuple[int, int]:
    """(length, step that completes it) of a longest increasing run of places, one of each step at most; ends at ``want``.

    The places of a step are in descending order, so no two of them make a run.
    """
    tops: list[int] = []
    at = -1
    for i, places in enumerate(steps):
        for p in places:
            k = bisect.bisect_left(tops, p)
            if k == len(tops):
                tops.append(p)
                at = i
            else:
                tops[k] = p
        if len(tops) == want:
            break
    return len(tops), at


def start_of(steps: Sequence[Sequence[int]], lo: int, end: int, want: int) -> int:
    """The last step from which a run of ``want`` places ends at step ``end``."""
    return end - grown(([-p for p in reversed(steps[i])] for i in range(end, lo - 1, -1)), want)[1]


def stretches(steps: Sequence[Sequence[int]], need: int) -> list[tuple[int, int, int]]:
    """(words aligned, first step, last step) of each place that aligns ``need`` words or more; places do not overlap."""
    tight, lo = [], 0
    while True:
        n, at = grown((steps[i] for i in range(lo, len(steps))), need)
        if n < need:
            break
        end = lo + at
        tight.append((start_of(steps, lo, end, need), end))
        lo = end + 1
    out, lo = [], 0
    for k in range(len(tight)):
        hi = tight[k + 1][0] if k + 1 < len(tight) else len(steps)
        n, at = grown(steps[i] for i in range(lo, hi))
        end = lo + at
        out.append((n, start_of(steps, lo, end, n), end))
        lo = end + 1
    return out


def anchored(text: Sequence[int], template: Sequence[int]) -> list[tuple[int, int]]:
    """(place in text, place in template) of the aligned words, by unique words, gap by gap."""
    out, gaps = [], [(0, len(text), 0, len(template))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        in_text, in_template = Counter(text[a0:a1]), Counter(template[b0:b1])
        spot = {w: k for k, w in enumerate(template[b0:b1], b0) if in_template[w] == 1}
        unique = [(k, spot[w]) for k, w in enumerate(text[a0:a1], a0) if in_text[w] == 1 and w in spot]
        if unique:
            kept = [unique[i] for i in increasing([b for _, b in unique])]
            edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
            gaps += [(x + 1, u, y + 1, v) for (x, y), (u, v) in itertools.pairwise(edges)]
        else:
            kept = _common(text, template, a0, a1, b0, b1)
        out += kept
    return sorted(out)


def _common(text, template, a0, a1, b0, b1) -> list[tuple[int, int]]:
    """Longest common subsequence of a gap: each text word stands for all its template places, last first."""
    spots: dict = {}
    for k in range(b1 - 1, b0 - 1, -1):
        spots.setdefault(template[k], []).append(k)
    pairs = [(k, b) for k in range(a0, a1) for b in spots.get(text[k], ())]
    return [pairs[i] for i in increasing([b for _, b in pairs])]


def winners(places: list[tuple], families: Mapping[str, str] = FAMILIES) -> list[tuple]:
    """Of (aligned, size, first, last, foreign, name) the ones that no better overlapping one of their family beats."""
    out: list[tuple] = []
    family = lambda p: families.get(p[5], p[5])
    for place in sorted(places, key=lambda p: (-p[0] / p[1], p[4], -p[1], p[2], p[5])):
        if all(place[3] < o[2] or place[2] > o[3] for o in out if family(o) == family(place)):
            out.append(place)
    return sorted(out, key=lambda p: (p[2], p[5]))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage_pct: int = 80, names: Mapping[str, str] = NAMES,
         others: Mapping[str, str] = OTHERS) -> DataFrame:
    """(doc_id, license, coverage, first_word, n_words): each place where a template is covered to ``coverage_pct`` percent."""
    prints = lambda text: tokens(pa.array([text], pa.string()))[0].tolist()
    known = []
    for name, text in templates.items():
        words = prints(text)
        vocab = np.array(sorted(set(words)), np.uint64)
        seen = np.zeros(1 << 16, bool)
        seen[vocab >> np.uint64(48)] = True
        places = [[j for j in range(len(words) - 1, -1, -1) if words[j] == w] for w in vocab.tolist()]
        known.append((name, words, vocab, seen, places, set(prints(names.get(name, ""))), set(prints(others.get(name, "")))))
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])

    def found_in(hashed, first, name, words, vocab, seen, places, must, never):
        """(row, place) of one template; see ``winners``."""
        size = len(words)
        need = max(1, -(-coverage_pct * size // 100))
        at = np.flatnonzero(seen[hashed >> np.uint64(48)])
        word = np.minimum(np.searchsorted(vocab, hashed[at]), len(vocab) - 1)
        own = vocab[word] == hashed[at]
        at, word = at[own], word[own]
        row = np.searchsorted(first, at, "right") - 1
        many = np.bincount(row * len(vocab) + word, minlength=(len(first) - 1) * len(vocab)).reshape(-1, len(vocab))
        enough = np.minimum(many, [len(p) for p in places]).sum(1) >= need
        for r in np.flatnonzero(enough):
            lo, hi = np.searchsorted(row, r, "left"), np.searchsorted(row, r, "right")
            here = at[lo:hi]
            for in_order, a, b in stretches([places[w] for w in word[lo:hi].tolist()], need):
                text = hashed[here[a: b + 1]].tolist()
                pairs = anchored(text, words)
                if len(pairs) < in_order:
                    pairs = _common(text, words, 0, len(text), 0, size)
                start, end = int(here[a + pairs[0][0]]), int(here[a + pairs[-1][0]])
                inside = set(hashed[start: end + 1].tolist())
                if must <= inside and not never & inside:
                    yield int(r), (len(pairs), size, start, end, end - start + 1 - len(pairs), name)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashed, first = tokens(part.column("text"))
            ids = part.column("doc_id").to_pylist()
            by_row: dict[int, list] = {}
            for template in known:
                for r, place in found_in(hashed, first, *template):
                    by_row.setdefault(r, []).append(place)
            rows = [(ids[r], name, n / size, start - int(first[r]), end - start + 1)
                    for r in sorted(by_row) for n, size, start, end, _, name in winners(by_row[r])]
            if rows:
                yield batch_of(schema, [list(c) for c in zip(*rows, strict=True)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        search, "doc_id long, license string, coverage double, first_word long, n_words long")
