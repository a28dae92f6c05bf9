"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside it.

A text's features are the square roots of the shares of its hashed byte bigrams
and trigrams (case and punctuation folded), over the whole text. The family is
the best of one-versus-rest linear SVMs; inside it each pair of languages has an
SVM of its own, the most votes win, and ties go to the larger sum of margins. The
score is the family's logistic probability times the least of the winner's
pairwise ones.

Families are given by FAMILY; a language that isn't in it is a family of its own.
Learning takes all languages, at most SAMPLE documents of each and some SAMPLE_ALL in
all, those with the least hash. What may be among them is known from the language's
count, so that no language's documents meet in a task.

Cases: text that is null or has no letter is `und` with score 0. Documents with a
null lang or in the held-out fold aren't learnt from. If one language is learnt,
every text with a letter is that; if none (as from an empty table), all are `und`.
Rows that repeat a doc_id are predicted one by one and learnt from once. Very long
texts count whole. Other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C
from . import docstats as S

BITS = 11
DIM = 1 << BITS
SAMPLE, SAMPLE_ALL = 1_200, 24_000
# Families of languages.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "indo-aryan": "hi bn mr ne pa gu ur",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt",
    "malayic": "id ms",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_ASCII = re.compile("[A-Za-z]")


def features(c: C.Chunk) -> np.ndarray:
    """texts x DIM float32 of unit length (zeros for an empty text)."""
    n = c.hi - c.lo
    out = np.zeros(n * DIM)
    if len(c.data) > 1:
        d = c.data.astype(np.uint32)
        doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(c.offs))
        two = d[:-1] << np.uint32(8) | d[1:]
        for size, key in ((2, two), (3, two[:-1] << np.uint32(8) | d[2:])):
            h = ((key + np.uint32(size << 27)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
            own, last = doc[: len(key)], doc[size - 1 :]
            inside = own == last
            out += np.bincount(own[inside] * DIM + h[inside], minlength=n * DIM)
    out = out.reshape(n, DIM)
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, epochs: int = 15, reg: float = 1e-4, seed: int = 3) -> np.ndarray:
    """Weights (the last a bias) of a linear SVM with squared hinge loss, y being -1 or 1; both sides weigh the same."""
    rng, w, m, v, step = np.random.default_rng(seed), np.zeros(x.shape[1] + 1, np.float32), 0.0, 0.0, 0
    side = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), 256):
            rows, step = order[lo : lo + 256], step + 1
            slack = np.maximum(0, 1 - y[rows] * (x[rows] @ w[:-1] + w[-1])) * side[rows]
            pull = -2 * slack * y[rows] / len(rows)
            g = np.append(x[rows].T @ pull + reg * w[:-1], pull.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = (w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


class Languages:
    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        y = np.array([self.langs.index(lang) for lang in langs], np.int64)
        names = [FAMILY.get(lang, lang) for lang in self.langs]
        self.families = sorted(set(names))
        self.members = [[i for i, f in enumerate(names) if f == g] for g in self.families]
        of = np.array([self.families.index(f) for f in names], np.int64)
        self.family = np.stack([svm(x, np.where(of[y] == g, 1.0, -1.0)) for g in range(len(self.families))]) if len(self.families) > 1 else None
        self.pairs = {}
        for own in self.members:
            for a, b in combinations(own, 2):
                rows = (y == a) | (y == b)
                self.pairs[a, b] = svm(x[rows], np.where(y[rows] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and score of each row."""
        n = len(x)
        apply = lambda w, rows: x[rows] @ w[:-1] + w[-1]
        prob = lambda z: 1 / (1 + np.exp(-np.clip(3 * z, -50, 50)))
        every = np.arange(n)
        family, score, lang = np.zeros(n, np.int64), np.ones(n), np.zeros(n, np.int64)
        if self.family is not None:
            margin = np.stack([apply(w, every) for w in self.family], axis=1)
            family, score = margin.argmax(axis=1), prob(margin.max(axis=1))
        for g, own in enumerate(self.members):
            rows = np.flatnonzero(family == g)
            lang[rows] = own[0]
            if len(own) == 1 or not len(rows):
                continue
            votes, sums, least = (np.zeros((len(rows), len(own))) for _ in range(3))
            least += 1
            for i, j in combinations(range(len(own)), 2):
                z = apply(self.pairs[own[i], own[j]], rows)
                votes[:, i], votes[:, j] = votes[:, i] + (z > 0), votes[:, j] + (z <= 0)
                sums[:, i], sums[:, j] = sums[:, i] + z, sums[:, j] - z
                least[:, i], least[:, j] = np.minimum(least[:, i], prob(z)), np.minimum(least[:, j], prob(-z))
            best = (votes * 1e6 + np.clip(sums, -1e5, 1e5)).argmax(axis=1)
            lang[rows] = np.array(own)[best]
            score[rows] *= least[np.arange(len(rows)), best]
        return lang, np.clip(score, 0, 1)


def fit(docs: DataFrame) -> Languages:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = docs.where("lang is not null and doc_id is not null and text is not null").where(~S.held_out())
    counts = C.Scratch(docs.sparkSession, "languages").save(known.groupBy("lang").agg(F.count("*").alias("n")), "counts")
    langs = counts.count()
    most = max(1, min(SAMPLE, SAMPLE_ALL // max(1, langs)))
    place = (F.xxhash64("doc_id").cast("double") / 2.0**64) + 0.5  # uniform; twice as many as are wanted lie below this bound
    ids = known.select("doc_id", "lang").join(F.broadcast(counts) if langs <= C.FEW else counts, "lang").where(place <= 2.0 * most / F.col("n") + 50 / F.col("n")).select("doc_id", "lang").distinct()
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = ids.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most).drop("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in C.chunks(b.column("text"), folded=True):
                x = features(c)
                n = c.hi - c.lo
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(c.lo, n), b.column("lang").slice(c.lo, n), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["doc_id", "lang", "x"])

    made = known.join(F.broadcast(ids), ["doc_id", "lang"]).mapInArrow(run, "doc_id long, lang string, x binary")
    rows = made.groupBy("doc_id", "lang").agg(F.min("x").alias("x")).orderBy("doc_id", "lang").toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16).reshape(-1, DIM).astype(np.float32)
    return Languages(x, rows.column("lang").to_pylist())


def _lettered(texts: pa.Array) -> np.ndarray:
    return np.array([bool(t and (_ASCII.search(t) or any(map(str.isalpha, t)))) for t in texts.to_pylist()], bool)


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in C.chunks(b.column("text"), folded=True):
                n = c.hi - c.lo
                known = _lettered(b.column("text").slice(c.lo, n)) & bool(model.langs)
                lang, score = np.array(["und"] * n, object), np.zeros(n)
                if known.any():
                    at, p = model.predict(features(c)[known])
                    lang[known], score[known] = np.array(model.langs, object)[at], p
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(c.lo, n), b.column("held_out").slice(c.lo, n), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), S.held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
