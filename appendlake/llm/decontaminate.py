"""Benchmark decontamination by latent semantic retrieval.

1. Words (case and punctuation folded) are hashed; the features are those that
   the benchmark has. Their document frequencies are counted over all documents.
2. Passages of WINDOW words, of the benchmark and of all documents, make a TF-IDF
   matrix A. One pass over the documents sums their part of A'A by pairs of
   features, in whole numbers, so that the sum doesn't hang on how the table is
   partitioned; it is written, and has as many rows as the block has pairs of
   features at most. A randomised SVD with power steps, each a distributed product
   (A'A) X, gives RANK directions. The benchmark's rows weigh as much as the
   documents' together, else its rare words would be lost.
3. Every window of every document meets every benchmark passage, in blocks, by
   cosine in the latent space and by the share of the window's own length that
   the passage explains.
4. Windows that pass are joined to regions; an item counts as leaked if its
   longest common subsequence with a region has COMMON of the item's words, and
   that with the item's answer has ANSWER of the answer's words. Without a column
   `answer` the answer is the item's last sentence.

Only the benchmark goes to all tasks, in blocks of at most BLOCK_WORDS words and
BLOCK_PASSAGES passages (one item, if it has more): passages have few directions
in common, and a rank below their number loses the short ones. GROUP blocks are
sent and searched for at once, so that many items cost few passes.

Cases: null and empty texts leak nothing; items without words match nothing, and
items of fewer than SHORT words must be there in whole. Rows that repeat a doc_id
are searched one by one, equal findings come once. An item_id that comes again
with another text is another item; items are taken in the order of id, text and
answer, so that ties don't hang on how the table is partitioned. Very long texts are
searched window by window, whole. An empty table on either side gives no leaks. Other
columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

FEATURES = 1 << 20
WINDOW, STRIDE = 32, 16
RANK, EXTRA, POWER = 384, 16, 2
#: Units of a sum of products, pairs that a task holds, tasks that multiply.
UNIT, HELD, TASKS = 1 << 30, 4_000_000, 2
#: Words in a larger share of the documents than this aren't features, but for the rarer half of an item's.
OFTEN = 0.1
COSINE, EXPLAINED = 0.55, 0.25
COMMON, ANSWER, SHORT = 0.7, 0.5, 8
BLOCK_WORDS, BLOCK_PASSAGES, GROUP = 12_000, 300, 8
_U = np.uint64


class Benchmark:
    """A block of items: their words, passages and features."""

    def __init__(self, rows: list[tuple[int, str, str | None]]):
        self.ids, self.words, self.answers = [], [], []
        for item, text, answer in rows:
            w = _folded(text)
            if len(w):
                if answer is None:
                    parts = [p for p in text.replace("?", ".").replace("!", ".").split(".") if p.strip()]
                    answer = parts[-1] if parts else text
                self.ids.append(item)
                self.words.append(w)
                self.answers.append(_folded(answer))
        self.restrict(np.zeros(FEATURES, np.int64), 0)

    def restrict(self, df: np.ndarray, most: float) -> None:
        """Makes columns of the features, and passages of WINDOW words. Words in more than `most` documents aren't features, but for the rarer half of an item's words."""
        own = [_features(w) for w in self.words]
        wanted = [f[df[f] <= max(most, np.median(df[f]))] for f in own]
        features = np.unique(np.concatenate(wanted)) if own else np.zeros(0, np.int64)
        self.column = np.full(FEATURES, -1, np.int32)
        self.column[features] = np.arange(len(features))
        self.columns = len(features)
        self.passages, self.owner = [], []
        for i, f in enumerate(own):
            for at in np.linspace(0, max(0, len(f) - WINDOW), _passages(len(f))).astype(int):
                p = self.column[f[at : at + WINDOW]]
                self.passages.append(p[p >= 0])
                self.owner.append(i)
        self.owner = np.array(self.owner, np.int64)


def _folded(text: str | None) -> np.ndarray:
    return next(C.chunks(pa.array([text or ""]), 1 << 62, folded=True)).hashes()


def _passages(n: int) -> int:
    """How many passages n words have."""
    return max(1, -(-(n - WINDOW) // (WINDOW - 4)) + 1) if n > WINDOW else 1


def _features(h: np.ndarray) -> np.ndarray:
    return (h & _U(FEATURES - 1)).astype(np.int64)


def _gathered(table: np.ndarray, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of table[rows] by ascending position: first the first row of every position, then the second, and so on."""
    out = np.zeros((n, table.shape[1]), table.dtype)
    if not len(at):
        return out
    new = np.concatenate([[True], at[1:] != at[:-1]])
    first = np.flatnonzero(new)
    turn = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    order = np.argsort(turn, kind="stable")
    upto = np.concatenate([[0], np.cumsum(np.bincount(turn))])
    for lo, hi in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        for k in range(lo, hi, 1024):  # small enough for the cache
            part = order[k : min(k + 1024, hi)]
            out[at[part]] += table[rows[part]]
    return out


class Blocks:
    """A chunk's words in blocks of STRIDE words of one text; a window is WINDOW / STRIDE following blocks."""

    def __init__(self, c: C.Chunk):
        self.n = np.diff(c.first)
        self.per = -(-self.n // STRIDE)
        self.base = np.concatenate([[0], np.cumsum(self.per)])
        doc = c.docs_of_words()
        within = np.arange(len(doc)) - c.first[doc]
        self.of_word = self.base[doc] + within // STRIDE
        self.doc = np.repeat(np.arange(len(self.n)), self.per)
        self.start = (np.arange(len(self.doc)) - self.base[self.doc]) * STRIDE

    def windows(self, sums: np.ndarray) -> np.ndarray:
        out = sums.copy()
        for k in range(1, WINDOW // STRIDE):
            same = np.flatnonzero(self.doc[:-k] == self.doc[k:]) if len(self.doc) > k else np.zeros(0, np.int64)
            out[same] += sums[same + k]
        return out


def _frequencies(docs: DataFrame, blocks: list[Benchmark]) -> tuple[int, np.ndarray]:
    """How many documents there are with a word, and how many have each feature of the blocks."""
    features = np.unique(np.concatenate([np.flatnonzero(b.column >= 0) for b in blocks]))
    column, columns = np.full(FEATURES, -1, np.int32), len(features)
    column[features] = np.arange(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(columns + 1, np.int64)
        for batch in batches:
            for c in C.chunks(batch.column("text"), folded=True):
                at = column[_features(c.hashes())]
                doc = c.docs_of_words()
                key = np.unique(doc[at >= 0] * columns + at[at >= 0])
                total[:columns] += np.bincount(key % columns, minlength=columns)
                total[columns] += int((np.diff(c.first) > 0).sum())
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["f", "n"])

    out = np.zeros(columns + 1, np.int64)
    for f, n in docs.select("text").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toLocalIterator():
        out[f] = n
    df = np.zeros(FEATURES, np.int64)
    df[features] = out[:columns]
    return int(out[columns]), df


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of whole numbers by key, ascending."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def moments(docs: DataFrame, blocks: list[Benchmark], idfs: list[np.ndarray]) -> DataFrame:
    """block, f, g (f <= g), n: A'A of the TF-IDF rows of length 1 of all documents' passages, in units of 1 / UNIT."""
    known = [(b.column, b.columns, idf) for b, idf in zip(blocks, idfs, strict=True)]

    def products(at: np.ndarray, window: np.ndarray, columns: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        there = at >= 0
        cell, n = np.unique(window[there] * columns + at[there], return_counts=True)
        w, f = cell // columns, cell % columns
        value = n * idf[f]
        value = value / np.sqrt(np.bincount(w, value**2))[w] if len(w) else value
        keys, sums = [], []
        for d in range(WINDOW):  # a passage's features follow each other
            i = np.flatnonzero(w[: len(w) - d] == w[d:])
            if not len(i):
                break
            keys.append(f[i] * columns + f[i + d])
            sums.append(np.rint(value[i] * value[i + d] * UNIT).astype(np.int64))
        return _summed(np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *sums]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in known]

        def give(k: int) -> Iterator[pa.RecordBatch]:
            key, n = _summed(*(np.concatenate(c) for c in zip(*held[k], strict=True)))
            held[k], columns = [(key, n)], known[k][1]
            if len(key) > HELD // 2:
                held[k] = []
                yield out(k, columns, key, n)

        def out(k: int, columns: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array((key // columns).astype(np.int32)), pa.array((key % columns).astype(np.int32)), pa.array(n)], names=["block", "f", "g", "n"])

        for batch in batches:
            for c in C.chunks(batch.column("text"), folded=True):
                feature, size, doc = _features(c.hashes()), np.diff(c.first), c.docs_of_words()
                before = np.concatenate([[0], np.cumsum(-(-size // WINDOW))])
                window = before[doc] + (np.arange(len(doc)) - c.first[doc]) // WINDOW
                for k, (column, columns, idf) in enumerate(known):
                    held[k].append(products(column[feature], window, columns, idf))
                    if sum(len(key) for key, _ in held[k]) > HELD:
                        yield from give(k)
        for k, (_, columns, _) in enumerate(known):
            if held[k]:
                yield out(k, columns, *_summed(*(np.concatenate(c) for c in zip(*held[k], strict=True))))

    return docs.select("text").mapInArrow(run, "block int, f int, g int, n long").groupBy("block", "f", "g").agg(F.sum("n").alias("n"))


def directions(gram: DataFrame, b: Benchmark, idf: np.ndarray, seed: int = 5) -> np.ndarray:
    """columns x RANK right singular vectors of the passages' TF-IDF matrix, by subspace iteration on A'A; gram(f, g, n) is the documents' part."""
    width = min(RANK + EXTRA, b.columns)
    own = []  # the benchmark's rows: columns and values
    for p in b.passages:
        at, n = np.unique(p, return_counts=True)
        value = (n * idf[at]).astype(np.float32)
        own.append((at, value / max(float(np.linalg.norm(value)), 1e-9)))
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(b.columns, width)).astype(np.float32))[0]

    def product(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(x.shape)
            for batch in batches:
                f, g, n = (batch.column(i).to_numpy() for i in range(3))
                apart = f != g
                to, of, n = np.append(f, g[apart]), np.append(g, f[apart]), np.append(n, n[apart])
                order = np.argsort(to, kind="stable")
                for lo in range(0, len(order), 2048):
                    part = order[lo : lo + 2048]
                    first = np.flatnonzero(np.append(True, np.diff(to[part]) != 0))
                    total[to[part][first]] += np.add.reduceat((n[part] / UNIT)[:, None] * x[of[part]], first)
            there = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array([v.tobytes() for v in total[there].astype(np.float32)], pa.binary())], names=["f", "v"])

        out, mine = np.zeros(x.shape), np.zeros(x.shape, np.float32)
        for part in gram.coalesce(TASKS).mapInArrow(run, "f long, v binary").toArrow().to_batches():  # at most TASKS matrices
            out[part.column("f").to_numpy()] += np.frombuffer(b"".join(part.column("v").to_pylist()), np.float32).reshape(-1, x.shape[1])
        for at, value in own:
            mine[at] += value[:, None] * (value @ x[at])
        return mine + (out * (np.linalg.norm(mine) / max(np.linalg.norm(out), 1e-12))).astype(np.float32)

    for _ in range(POWER + 1):
        x = np.linalg.qr(product(x))[0]
    u, _, _ = np.linalg.svd(x.T @ product(x))
    return np.ascontiguousarray((x @ u)[:, :RANK], np.float32)


class Index:
    """A benchmark block in the latent space; find() searches a chunk."""

    def __init__(self, b: Benchmark, idf: np.ndarray, v: np.ndarray):
        self.column, self.ids, self.words, self.answers, self.owner = b.column, b.ids, b.words, b.answers, b.owner
        self.idf = idf.astype(np.float32)
        self.v = v * self.idf[:, None]
        self.rest = float(np.median(idf)) ** 2 if len(idf) else 1.0
        q = np.stack([self.v[p].sum(axis=0) for p in b.passages]) if b.passages else np.zeros((0, v.shape[1]), np.float32)
        self.q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)

    def candidates(self, c: C.Chunk, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, item, cosine) of windows that pass."""
        at, blocks = self.column[_features(h)], Blocks(c)
        there = at >= 0
        latent = blocks.windows(_gathered(self.v, at[there], blocks.of_word[there], len(blocks.doc)))
        square = np.full(len(h), self.rest, np.float32)
        square[there] = self.idf[at[there]] ** 2
        own = np.sqrt(blocks.windows(np.bincount(blocks.of_word, square, len(blocks.doc)).astype(np.float32)[:, None])[:, 0])
        norm = np.linalg.norm(latent, axis=1)
        # A window whose whole latent part explains too little of it can't pass: its cosine is 1 at most.
        may = np.flatnonzero(norm >= EXPLAINED * np.maximum(own, 1e-9))
        found = []
        for lo in range(0, len(may), 8192):
            rows = may[lo : lo + 8192]
            dot = latent[rows] @ self.q.T
            r, k = np.nonzero((dot >= COSINE * norm[rows][:, None]) & (dot >= EXPLAINED * own[rows][:, None]))
            found.append((rows[r], k, dot[r, k] / norm[rows][r]))
        r, k, cos = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        return blocks.doc[r], blocks.start[r], self.owner[k], cos

    def find(self, c: C.Chunk, h: np.ndarray) -> list[tuple[int, int, int, int, float, float, float]]:
        """(text, item, first word, end, common, answer, cosine) of leaks."""
        doc, start, item, cos = self.candidates(c, h)
        out, order = [], np.lexsort((start, item, doc))
        i = 0
        while i < len(order):
            d, t = doc[order[i]], item[order[i]]
            n = len(self.words[t])
            j = i + 1
            while j < len(order) and doc[order[j]] == d and item[order[j]] == t and start[order[j]] - start[order[j - 1]] <= n + WINDOW:
                j += 1
            lo, hi = int(start[order[i]]), int(start[order[j - 1]]) + WINDOW
            best = (0.0, 0.0, 0, 0)
            # A long region is read in overlapping pieces, so that a common subsequence stays as close as an item is long.
            for a in range(max(0, lo - n), max(1, hi), max(n, WINDOW)):
                b = min(a + 2 * n + 2 * WINDOW, int(c.first[d + 1] - c.first[d]))
                part = h[c.first[d] + a : c.first[d] + b]
                common, answer = _common_share(self.words[t], part), _common_share(self.answers[t], part)
                best = max(best, (common, answer, a, b))
                if common == 1:
                    break
            common, answer, a, b = best
            if common >= (COMMON if n >= SHORT else 1.0) and answer >= ANSWER:
                out.append((int(d), int(t), a, b, common, answer, float(cos[order[i:j]].max())))
            i = j
        return out


def _common_share(want: np.ndarray, there: np.ndarray) -> float:
    """Longest common subsequence over the length of want, bit by bit in whole numbers."""
    if not len(want):
        return 1.0
    masks: dict[int, int] = {}
    for i, w in enumerate(want.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(want)) - 1
    v = full
    for w in there.tolist():
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return (len(want) - v.bit_count()) / len(want)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str, str | None]]]:
    """The items, in blocks bounded in words and in passages, read one after another."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    block, words, passages = [], 0, 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer")).dropDuplicates().orderBy("item_id", "text", "answer").toLocalIterator():
        size = len(_folded(row[1]))
        if not size:
            continue
        if block and (words + size > BLOCK_WORDS or passages + _passages(size) > BLOCK_PASSAGES):
            yield block
            block, words, passages = [], 0, 0
        block.append(tuple(row))
        words, passages = words + size, passages + _passages(size)
    if block:
        yield block


def build(scratch: C.Scratch, docs: DataFrame, items: list[list]) -> list[Index]:
    """The indexes of a group of blocks."""
    blocks = [Benchmark(x) for x in items]
    blocks = [b for b in blocks if b.columns]
    if not blocks:
        return []
    total, df = _frequencies(docs, blocks)
    for b in blocks:
        b.restrict(df, OFTEN * total)
    idfs = [np.log((total + 1) / (df[np.flatnonzero(b.column >= 0)] + 1)) + 0.1 for b in blocks]
    gram = scratch.save(moments(docs, blocks, idfs), "moments")
    made = [Index(b, idf, directions(gram.where(F.col("block") == i).select("f", "g", "n"), b, idf)) for i, (b, idf) in enumerate(zip(blocks, idfs, strict=True))]
    scratch.drop("moments")
    return made


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, end_word, common, answer, cosine: a row for each item that a region of a document holds."""
    return _found(spark, docs, benchmark).drop("digest").distinct()


def _found(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """leaks() with the MD5 digest of the document's text, which tells documents of one id apart."""
    C.bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = C.Scratch(spark, "leaks")
    schema = "doc_id long, digest binary, item_id long, start_word int, end_word int, common double, answer double, cosine double"
    found = spark.createDataFrame([], schema)
    for turn, items in enumerate(itertools.batched(_blocks(benchmark), GROUP)):
        if not (made := build(scratch, docs, list(items))):
            continue
        indexes = spark.sparkContext.broadcast(made)

        def run(batches: Iterator[pa.RecordBatch], indexes=indexes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c in C.chunks(batch.column("text"), folded=True):
                    ids, texts, h = batch.column("doc_id").slice(c.lo, c.hi - c.lo), batch.column("text").slice(c.lo, c.hi - c.lo), c.hashes()
                    for x in indexes.value:
                        cols = list(zip(*x.find(c, h), strict=True)) or [[]] * 7
                        digest = {i: hashlib.md5(texts[i].as_py().encode(), usedforsecurity=False).digest() for i in set(cols[0])}
                        arrays = [ids.take(pa.array(cols[0], pa.int64())), pa.array([digest[i] for i in cols[0]], pa.binary()), pa.array([x.ids[i] for i in cols[1]], pa.int64()), *(pa.array(cols[i], pa.int32()) for i in (2, 3)), *(pa.array(cols[i], pa.float64()) for i in (4, 5, 6))]
                        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "digest", "item_id", "start_word", "end_word", "common", "answer", "cosine"])

        # A group's findings are written before the next group's indexes are made, so that one group's are held at a time.
        found = found.unionByName(scratch.save(docs.mapInArrow(run, schema).distinct(), f"found-{turn}"))
        indexes.destroy()
        del made, indexes, run
    return found


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, all their columns as they were. A row goes by its own text, whatever rows share its doc_id."""
    id_, digest = (C.spare(docs.columns, c) for c in ("id", "digest"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    found = _found(spark, docs, benchmark).select(key.alias(id_), F.col("digest").alias(digest)).distinct()
    rows = docs.withColumns({id_: key, digest: F.coalesce(F.unhex(F.md5(F.col("text").cast("string"))), F.lit(b""))})
    return rows.join(found, [id_, digest], "left_anti").drop(id_, digest)
