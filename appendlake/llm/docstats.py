"""Statistics of whole texts, computed for a chunk of texts at once, and those of labelled texts, all or a bounded sample.

A null text has the statistics of an empty one. Words are runs without ASCII
white space; lines are cut at newlines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Labelled rows that a classifier is fitted on, at most: those with the least hash of doc_id.
SAMPLE_ROWS = 20_000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "bangs", "pipes", "digits", "distinct",
    "stops", "line_words", "wide", "top_word", "long_words", "closed_lines", "odd_ends", "short_words",
]
#: Features of which more never makes a text better.
WORSE = ["symbols", "dup_lines", "repeats", "upper", "bangs", "pipes", "top_word"]
_U = np.uint64


def _is(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _LETTER = _is(b"#*$%&|<>"), _is(bytes(range(65, 91))), _is(bytes([*range(65, 91), *range(97, 123)]))
_STOP, _BANG, _PIPE, _DIGIT, _LINE = _is(b".?!"), _is(b"!"), _is(b"|"), _is(bytes(range(48, 58))), _is(b"\n")
_WIDE = np.arange(256) >= 0xC0
_ODD = _is(b"#*$%&|<>!=/\\{}[]^~_")


def _runs(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal (doc, key): the doc of each distinct pair, its count, and each row's count."""
    full = C.mix64(key + doc.astype(_U) * C._GOLD)
    order = np.argsort(full)
    s = full[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(s)))
    each = np.empty(len(s), np.int64)
    each[order] = np.repeat(n, n)
    return doc[order[at]], n, each


def base_counts(c: C.Chunk, h: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """texts x BASE, and parts that features() needs too."""
    n = c.hi - c.lo
    words = np.diff(c.first)
    white = C._WHITE[c.data]
    chars = C.per_text(C.code_points(c.data) & ~white, c.offs)
    symbols = C.per_text(_SYMBOL[c.data], c.offs)
    # Lines: cut at newlines and at the texts' ends.
    cuts = np.flatnonzero(_LINE[c.data])
    begin = np.unique(np.concatenate([c.offs[:-1], cuts + 1]))
    begin = begin[begin < len(c.data)]
    doc = np.searchsorted(c.offs, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], len(c.data)), c.offs[1:][doc]) if len(begin) else begin
    end = end - (_LINE[c.data[end - 1]] if len(end) else 0)
    total = np.zeros(len(c.data) + 1, _U)
    np.cumsum(C._TABLE[c.data] * C._power(C._BASE, len(c.data)), out=total[1:])
    inner = np.concatenate([[0], np.cumsum(~white, dtype=np.int64)])
    worded = inner[end] > inner[begin] if len(begin) else np.zeros(0, bool)
    begin, end, doc = begin[worded], end[worded], doc[worded]
    key = (total[end] - total[begin]) * C._power(C._INV, max(1, len(c.data)))[begin] + (end - begin).astype(_U)
    line_doc, _, _ = _runs(doc, key)
    lines = np.bincount(doc, minlength=n)
    dup = lines - np.bincount(line_doc, minlength=n)
    # Windows of three words found again.
    s, d, at = C.shingles(h, c.first, 3)
    _, _, each = _runs(d, s)
    again = at[each > 1]
    covered = np.zeros(len(h) + 3, bool)
    for t in range(3):
        covered[again + t] = True
    word_doc = c.docs_of_words()
    repeats = np.bincount(word_doc[covered[: len(h)]], minlength=n)
    closed = np.bincount(doc[_STOP[c.data[end - 1]]], minlength=n) if len(end) else np.zeros(n)
    return np.stack([words, chars, symbols, dup, repeats], axis=1).astype(np.int64), {"lines": lines, "word_doc": word_doc, "closed": closed}


def features(c: C.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """texts x BASE (int64) and texts x FEATURES (float64) of a chunk."""
    h = c.hashes()
    base, parts = base_counts(c, h)
    n, words = c.hi - c.lo, np.maximum(base[:, 0], 1)
    count = lambda table: C.per_text(table[c.data], c.offs)
    letters = np.maximum(count(_LETTER) + count(_WIDE), 1)
    word_doc, length = parts["word_doc"], c.ends - c.starts
    distinct_doc, times, _ = _runs(word_doc, h)
    top = np.zeros(n)
    np.maximum.at(top, distinct_doc, times)
    share = lambda mask: np.bincount(word_doc[mask], minlength=n) / words
    last = c.data[c.ends - 1] if len(c.ends) else np.zeros(0, np.uint8)
    return base, np.stack(
        [
            np.log1p(base[:, 0]), base[:, 1] / words, base[:, 2] / words, base[:, 3] / np.maximum(parts["lines"], 1), base[:, 4] / words,
            count(_UPPER) / letters, count(_BANG) / words, count(_PIPE) / words, count(_DIGIT) / np.maximum(base[:, 1], 1), np.bincount(distinct_doc, minlength=n) / words,
            count(_STOP) / words, words / np.maximum(parts["lines"], 1), count(_WIDE) / letters, top / words, share(length > 12), parts["closed"] / np.maximum(parts["lines"], 1), share(_ODD[last]), share(length <= 3),
        ],
        axis=1,
    )


def held_out() -> F.Column:
    """True for the fold that nothing is learnt from (a null doc_id: crc32 of the text 'null')."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def _known(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y of the labels outside the held-out fold; of several labels of a doc_id the least."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna().where(~held_out())
    return known.groupBy("doc_id").agg(F.min("y").alias("y"))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _statistics(keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`keep` and x, BASE and FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in C.chunks(b.column("text")):
                base, x = features(c)
                both = np.concatenate([base.astype(float), x], axis=1)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(c.lo, len(both)) for k in keep), pa.FixedSizeListArray.from_arrays(pa.array(both.ravel()), both.shape[1]).cast(pa.list_(pa.float64()))], names=[*keep, "x"])

    return run


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(BASE, FEATURES, label) of at most `rows` labelled documents outside the held-out fold.

    Of several labels of a doc_id the least counts, and of several texts the least statistics.
    """
    known = _known(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = _plain(docs).join(F.broadcast(known), "doc_id").mapInArrow(_statistics(["doc_id", "y"]), "doc_id long, y int, x array<double>")
    got = found.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("doc_id").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(BASE) + len(FEATURES))
    return x[:, : len(BASE)].astype(np.int64), x[:, len(BASE) :], got["y"].to_numpy(int)


def all_labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y, x (BASE and FEATURES) of all labelled documents outside the held-out fold, chosen as in labelled(); statistics are joined, not texts."""
    found = _plain(docs).where("doc_id is not null").where(~held_out()).mapInArrow(_statistics(["doc_id"]), "doc_id long, x array<double>")
    return found.join(_known(labels, label), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x"))


def score_texts(docs: DataFrame, give: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str, keep: list[str]) -> DataFrame:
    """Runs give(BASE, FEATURES) over all texts; the columns `keep` pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in C.chunks(b.column("text")):
                made = give(*features(c))
                yield pa.RecordBatch.from_arrays([b.column(k).slice(c.lo, c.hi - c.lo) for k in keep] + [pa.array(v) for v in made.values()], names=[*keep, *made])

    return docs.mapInArrow(run, schema)
