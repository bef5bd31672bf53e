"""Toxicity by a classifier chain.

Categories are predicted one after the other: the model of each is linear over word features (whole words and beginnings) and the probabilities of
the categories before it.  In training these probabilities are out-of-fold, so a later model learns from predictions as
wrong as it will meet.

Fitting uses a bounded sample of labelled documents (``fit_rows``, drawn by a seeded hash) and the ``features`` words
that best tell labelled toxic documents from the others; everything is scored over whole texts.

Defined cases: null or empty text has no features and gets the intercepts; a category without both outcomes in the
sample is its base rate; labels of unknown documents are ignored, a document labelled twice counts as toxic if any
label says so, and rows of one ``doc_id`` are fitted once, by the smallest text.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Texts, batch_of, mix, row_of, slices

FIT_ROWS, FEATURES, FOLDS = 8000, 256, 5
PREFIXES = (4, 6)
# fixed values: words that mark the two kinds of abuse among documents labelled toxic
CATEGORIES = {
    "personal": ("idiot", "moron", "loser", "clown", "scum"),
    "contempt": ("stupid", "pathetic", "worthless", "trash", "disgusting"),
}
PENALTY = 0.1


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, row) of all words and of their first four and six bytes, A-Z lower-cased; ASCII signs separate words.

    The beginnings stand for families of coined words; rows are in order.
    """
    texts = Texts(column, lower=True)
    n = int(texts.offsets[-1])
    body = texts.buf[:n]
    ink = (body >= 128) | ((body >= 97) & (body <= 122)) | ((body >= 48) & (body <= 57))
    starts, ends, first = texts._runs(ink, n)
    row = row_of(first)
    out, of = [texts.hashes(starts, ends)], [row]
    for size in PREFIXES:
        longer = ends - starts > size
        out.append(mix(texts.hashes(starts[longer], starts[longer] + size), np.uint64(size)))
        of.append(row[longer])
    row = np.concatenate(of)
    order = np.argsort(row, kind="stable")
    return np.concatenate(out)[order], row[order]


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights with the intercept last, by Newton steps on the penalised likelihood."""
    if y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return np.append(np.zeros(x.shape[1]), np.log(rate / (1 - rate)))
    a = np.column_stack((x, np.ones(len(x))))
    penalty = np.append(np.full(x.shape[1], PENALTY), 1e-6)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = probability(x, w)
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    """Linear models in order; model k sees the features and k earlier probabilities."""

    def __init__(self, words: np.ndarray, names: list[str], x: np.ndarray, targets: np.ndarray, folds: int = FOLDS):
        self.words, self.names, self.models = words, names, []
        fold = np.arange(len(x)) % folds
        for k in range(len(names)):
            y = targets[:, k]
            self.models.append(fit_logistic(x, y))
            honest = np.empty(len(x))
            for f in range(folds):
                out = fold == f
                honest[out] = probability(x[out], fit_logistic(x[~out], y[~out])) if (~out).any() else y.mean()
            x = np.column_stack((x, honest))

    def predict(self, x: np.ndarray) -> np.ndarray:
        for w in self.models:
            x = np.column_stack((x, probability(x, w)))
        return x[:, -len(self.models):] if self.models else x[:, :0]

    def features(self, column: pa.Array) -> np.ndarray:
        hashed, row = word_hashes(column)
        x = np.zeros((len(column), len(self.words)))
        if len(self.words):
            seen = np.zeros(1 << 16, bool)
            seen[self.words >> np.uint64(48)] = True
            maybe = seen[hashed >> np.uint64(48)]
            hashed, row = hashed[maybe], row[maybe]
            at = np.minimum(np.searchsorted(self.words, hashed), len(self.words) - 1)
            same = self.words[at] == hashed
            x[row[same], at[same]] = 1.0
        return x


def fit(docs: DataFrame, labels: DataFrame, categories: Mapping[str, tuple[str, ...]] = CATEGORIES, fit_rows: int = FIT_ROWS,
        features: int = FEATURES) -> Chain:
    """The chain of ``categories`` (labelled toxic and naming one of the words) and, last, ``toxic`` itself."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    there = marked.count()
    drawn = marked.where(F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id")), F.lit(1_000_000)) < 1_000_000 * fit_rows / max(there, 1))
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int64()), ("words", pa.list_(pa.int64()))])

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashed, row = word_hashes(part.column("text"))
            lists = [np.unique(x).view(np.int64) for x in np.split(hashed, np.searchsorted(row, np.arange(1, part.num_rows)))]
            yield batch_of(schema, [part.column("doc_id"), part.column("toxic"), lists])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(drawn, "doc_id")
    one = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = one.mapInArrow(bag, "doc_id long, toxic long, words array<long>").persist()
    counts = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    n, pos = counts.n or 0, counts.pos or 0
    names = [*categories, "toxic"]
    if not n:
        sample.unpersist()
        return Chain(np.zeros(0, np.uint64), names, np.zeros((1, 0)), np.zeros((1, len(names))))
    by_word = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("p"), F.count("*").alias("d"))
    # squared deviation of the toxic count from what the word's frequency explains
    told = by_word.where("d >= 3").withColumn("gain", F.pow(F.col("p") - F.col("d") * pos / n, 2) / (F.col("d") * F.lit((pos + 1) / (n + 1))))
    top = [r.word for r in told.orderBy(F.desc("gain"), "word").limit(features).collect()]
    named = {k: Texts(pa.array(list(v), pa.string())) for k, v in categories.items()}
    marks = {k: [int(h) for h in t.hashes(t.offsets[:-1], t.offsets[1:]).view(np.int64)] for k, t in named.items()}
    wanted = sorted({*top, *[h for v in marks.values() for h in v]})
    some = sample.select("doc_id", "toxic", F.array_intersect("words", F.array(*[F.lit(w) for w in wanted])).alias("words")).orderBy("doc_id").collect()
    sample.unpersist()
    words = np.sort(np.array(top, np.int64).view(np.uint64))
    place = {int(w): i for i, w in enumerate(words.view(np.int64))}
    x = np.zeros((len(some), len(words)))
    targets = np.zeros((len(some), len(names)))
    for i, r in enumerate(some):
        x[i, [place[w] for w in r.words if w in place]] = 1.0
        targets[i] = [*[r.toxic and bool(set(marks[k]) & set(r.words)) for k in categories], r.toxic]
    return Chain(words, names, x, targets)


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_<category> for each category of the chain, and ``toxic`` for every row of ``docs``."""
    names = [f"p_{x}" for x in chain.names]
    schema = pa.schema([("doc_id", pa.int64()), *[(x, pa.float64()) for x in names]])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield batch_of(schema, [part.column("doc_id"), *chain.predict(chain.features(part.column("text"))).T])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rate, "doc_id long, " + ", ".join(f"{x} double" for x in names))
    return out.withColumn("toxic", F.col(names[-1]) >= threshold)
