"""MinHash near-dedup: BagMinHash signatures, banding, exact multiset verification, classes.

A text is the multiset of its windows of five words. Two texts are linked if
the multisets overlap (sum of minima over sum of maxima) in 0.8 or more; a
class is a connected component of links.

Signatures: each shingle has independent Poisson processes over dyadic levels
of its weight, [0,1), [1,2), [2,4), ...; a text with weight w keeps the points
that lie below w and a register keeps the earliest of its points, so that two
registers agree with just the weighted Jaccard probability. Only points before
a limit are made, which is where most of the work goes away; the limit doubles
for texts that still have an empty register.

Equal texts are one node, and what follows is about nodes that share a bucket:

1. A bucket's pivot is the member that shares buckets with most others: of variants
   of one text, the one nearest to all. Each member is held against its pivot.
2. What then shares a bucket with another class is held against single members of
   it: first each against its nearest one, and after these links have joined
   classes, against all that are left.

Before any text is read, a pair must pass its sketches: SKETCH bits, each the parity
of how many occurrences of shingles fall on it. Two sketches differ in no more bits
than the bags in occurrences, so a pair that differs in more than 0.8 allows is no
link, for certain; for long texts the bound is the number of bits that so many
occurrences change, and six standard deviations. Pairs of one class aren't listed.

Cases: a null or an empty text has no shingles and is linked to equal texts
only (nulls to nothing). A text of one to four words has one shingle. Very long
texts are read whole; their sketches let more pairs through. Rows that repeat a
doc_id keep a row each; a null doc_id stays null and is the class of nothing else
unless all members' ids are null. An empty table gives an empty one. Other columns,
whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5  # a pair at 0.8 shares no band with a probability of 7e-6
REGISTERS = BANDS * ROWS
SKETCH = 1024  # bits
_LONGS = [f"s{i}" for i in range(SKETCH // 64)]
_U = np.uint64


def bag_minhash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m registers (float64 bits as uint64) of n bags given as rows of (doc, shingle, weight)."""
    out = np.full(n * m, np.inf)
    total = np.bincount(doc, weight, n)
    todo = total > 0
    limit = np.where(todo, (np.log(m) + 5) / np.maximum(total, 1), 0)
    while todo.any():
        mine = todo[doc]
        d0, s0, w0 = doc[mine], shingle[mine], weight[mine]
        levels = np.where(w0 > 1, np.ceil(np.log2(np.maximum(w0, 1))).astype(np.int64), 0) + 1
        d, s, w = np.repeat(d0, levels), np.repeat(s0, levels), np.repeat(w0, levels)
        level = np.arange(len(d)) - np.repeat(np.cumsum(levels) - levels, levels)
        size = np.where(level > 0, 2.0 ** np.maximum(level - 1, 0), 1.0)
        low = np.where(level > 0, size, 0.0)
        seed = C.mix64(s + (level.astype(_U) + _U(1)) * C._GOLD)
        t, step, at = np.zeros(len(d)), 0, np.arange(len(d))
        while len(at):
            block = int(min(256, max(1, 60_000 // len(at))))
            index = np.arange(step + 1, step + block + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)
            h = C.mix64(seed[at][:, None] + index[None, :])
            gaps = -np.log(((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (size[at] * m)[:, None]
            gaps[:, 0] += t[at]
            times = np.cumsum(gaps, axis=1)
            keep = times < limit[d[at]][:, None]
            rows, cols = np.nonzero(keep)
            g, rows_t, own = C.mix64(h[rows, cols] ^ C._GOLD), times[rows, cols], at[rows]
            below = low[own] + (g >> _U(40)).astype(np.float64) * 2.0**-24 * size[own] < w[own]
            register = ((g[below] & _U(0xFFFFFFFF)) * _U(m)) >> _U(32)
            np.minimum.at(out, d[own[below]] * m + register.astype(np.int64), rows_t[below])
            t[at] = times[:, -1]
            at = at[keep[:, -1]]
            step += block
        todo &= np.isinf(out.reshape(n, m)).any(axis=1)
        limit *= 2
    return out.view(_U).reshape(n, m)


def bags(c: C.Chunk, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle, weight) of a chunk's texts."""
    s, d, _ = C.shingles(c.hashes(), c.first, k)
    key = C.mix64(s + d.astype(_U) * C._GOLD)
    order = np.argsort(key)
    key, s, d = key[order], s[order], d[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    return d[at], s[at], np.diff(np.append(at, len(key)))


def _bands(sig: np.ndarray) -> np.ndarray:
    x = sig.reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U) * _U(0xA0761D6478BD642F), x.shape[:2]).copy()
    for r in range(ROWS):
        h = C.mix64(h ^ x[:, :, r]) * C._MIX1
    return h


def _sketch(d: np.ndarray, s: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """n x SKETCH / 64 int64: the parities of the occurrences of bags given as rows of (doc, shingle, weight)."""
    turn = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
    bit = (C.mix64(np.repeat(s, w) + (turn.astype(_U) + _U(1)) * C._MIX2) & _U(SKETCH - 1)).astype(np.int64)
    odd = (np.bincount(np.repeat(d, w) * SKETCH + bit, minlength=n * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, SKETCH), axis=1).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in C.chunks(b.column("text")):
            n = c.hi - c.lo
            d, s, w = bags(c)
            some = np.diff(c.first) > 0
            bands = _bands(bag_minhash(d, s, w, n)).view(np.int64)
            sizes = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("node").slice(c.lo, n),
                    pa.array(np.bincount(d, w, n).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(bands[some].ravel())),
                    pa.FixedSizeListArray.from_arrays(pa.array(_sketch(d, s, w, n).ravel()), SKETCH // 64).cast(pa.list_(pa.int64())),
                ],
                names=["node", "size", "bands", "sketch"],
            )


def _overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Multiset Jaccard of two sorted arrays."""
    if not len(a) or not len(b):
        return 0.0
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = np.minimum(np.where(x[at] == y, nx[at], 0), ny).sum()
    return float(both) / (len(a) + len(b) - both)


def _of(text: str) -> np.ndarray:
    c = next(C.chunks(pa.array([text]), 1 << 62))
    return C.shingles(c.hashes(), c.first, SHINGLE)[0]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        last, mine, sims = None, None, []
        for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True):
            if x is not last and x != last:
                last, mine = x, _of(x)
            sims.append(_overlap(mine, _of(y)))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sims, pa.float64())], names=["a", "b", "sim"])


def _differ(x: str, y: str) -> str:
    """SQL for the bits in which two sketches differ."""
    return " + ".join(f"bit_count({x}.{c} ^ {y}.{c})" for c in _LONGS)


def _may_link(x: str, y: str) -> F.Column:
    """Whether the sketches of x and y, frames with _LONGS and size, let them be linked."""
    n = f"(({x}.size + {y}.size) * {(1 - SIMILARITY) / (1 + SIMILARITY)!r}D + 1e-6D)"  # occurrences of one bag only, at most
    one, two, four = (f"pow({1 - k / SKETCH!r}D, {n})" for k in (2, 2, 4))
    mean = f"{SKETCH / 2}D * (1D - {one})"
    var = f"{SKETCH / 4}D * (1D - {two} * {two}) + {SKETCH * (SKETCH - 1) / 4}D * ({four} - {two} * {two})"
    return F.expr(f"{_differ(x, y)} <= {n} and {_differ(x, y)} <= {mean} + 6D * sqrt(greatest(0D, {var}))")


class NearDuplicates:
    """classes(): doc_id, class_id, class_size for each row of docs(doc_id, text)."""

    def __init__(self, spark: SparkSession, docs: DataFrame):
        C.bound_batches(spark)
        self.spark, self.scratch = spark, C.Scratch(spark, "near")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.docs = self.docs.withColumn("node", F.unhex(F.md5(F.col("text"))))

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Members (doc_id, node), and classes of linked nodes (node, comp)."""
        save = self.scratch.save
        members = save(self.docs.select("doc_id", "node"), "members")
        signed = save(self.docs.where("text is not null").select("node", "text").mapInArrow(_sign, "node binary, size long, bands array<long>, sketch array<long>"), "signed")
        # A bucket matters if it has two different nodes; pre-aggregated before the shuffle.
        entries = signed.select("node", F.explode("bands").alias("key"))
        shared = entries.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
        buckets = save(entries.join(shared, "key").select("key", "node").distinct(), "buckets")
        if buckets.isEmpty():
            return members, self.spark.createDataFrame([], "node binary, comp binary")
        full = buckets.join(buckets.groupBy("key").agg(F.count("*").alias("n")), "key")
        near = full.groupBy("node").agg(F.sum("n").alias("near"), F.sort_array(F.collect_list("key")).alias("keys"))  # at most BANDS keys
        info = signed.groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))
        nodes = save(near.join(info, "node").select("node", "near", "keys", "size", *(F.col("sketch")[i].alias(c) for i, c in enumerate(_LONGS))), "nodes")
        # Of equal texts, the row with the least id gives the text; equal texts meet by (node, id), which spreads them.
        spare = F.coalesce("doc_id", F.lit(-(2**63))).alias("id")
        least = members.select("node", spare).groupBy("node").agg(F.min("id").alias("id"))
        needed = least.join(nodes.select("node"), "node")
        texts = self.docs.select("node", spare, "text").join(needed.hint("shuffle_hash"), ["node", "id"]).select("node", "text")
        texts = save(texts.dropDuplicates(["node"]), "texts")

        own = buckets.join(nodes.drop("keys"), "node")
        pivots = own.groupBy("key").agg(F.max(F.struct("near", "node", "size", *_LONGS)).alias("p")).select("key", "p.*")
        stars = own.alias("x").join(pivots.alias("y"), F.expr("x.key = y.key and x.node <> y.node") & _may_link("x", "y"))
        good = self._linked(texts, stars.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")), "stars")
        comps = C.components(self.scratch, good, "cc-a")
        left = save(self._left(buckets, nodes, comps), "left")
        for turn in ("nearest", "rest"):
            if left.isEmpty():
                break
            some = left
            if turn == "nearest":  # of each node one, so that what many pairs would link is linked by few
                both = left.select("a", "b", "d").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
                some = both.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
            found = self._linked(texts, some, turn)
            good = good.unionByName(found)
            comps = C.components(self.scratch, comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(found), f"cc-{turn}")
            if turn == "nearest":
                of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
                left = left.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(comp_a, a) <> coalesce(comp_b, b)").select("a", "b", "d")
                left = save(left, "left-2")
        return members, comps

    def _left(self, buckets: DataFrame, nodes: DataFrame, comps: DataFrame) -> DataFrame:
        """(a, b, d): pairs of different classes that share a bucket, each in the least that both are in and may link; d: bits in which they differ."""
        own = buckets.join(comps.withColumnRenamed("comp", "c"), "node", "left").select("key", "node", F.coalesce("c", "node").alias("comp"))
        # Pairs inside a bucket's largest class aren't listed, so only the others look for partners.
        most = own.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("classes"))
        open_ = own.join(most.where("classes > 1").select("key", F.col("top.comp").alias("main")), "key").join(nodes, "node")
        open_ = self.scratch.save(open_.drop("near"), "open")
        few, other = open_.where("comp <> main").alias("x"), open_.alias("y")
        pairs = few.join(other, F.expr("x.key = y.key and x.comp <> y.comp and (y.comp = y.main or x.node < y.node)") & _may_link("x", "y") & F.expr("array_min(array_intersect(x.keys, y.keys)) = x.key"))
        return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.expr(_differ("x", "y")).alias("d"))

    def _linked(self, texts: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs(a, b), those whose bags overlap enough."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        full = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        found = full.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a binary, b binary, sim double")
        return self.scratch.save(found.where(F.col("sim") >= SIMILARITY).select("a", "b"), name)

    def grouped(self) -> DataFrame:
        """doc_id, node and group (a node of the class, null for a null text) for each row."""
        members, comps = self.links()
        return members.join(comps, "node", "left").select("doc_id", "node", F.coalesce("comp", "node").alias("group"))

    def classes(self) -> DataFrame:
        full = self.grouped()
        named = full.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
        # Null texts are alone.
        alone = full.where("group is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
        return full.where("group is not null").join(named, "group").select("doc_id", "class_id", "class_size").unionByName(alone)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (the class's least doc_id), class_size: one row for each document."""
    return NearDuplicates(spark, C.table(spark, sf_dir, "documents")).classes()


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of docs for each class, all its columns as they were: that with the least doc_id, of those the one with the least digest of its text.

    A class's ids count before nulls. Rows equal in doc_id and text are copies, of which the one whose
    JSON is least stays; rows that share a doc_id but not a class are kept each. Null texts stay.
    """
    full = NearDuplicates(spark, docs).grouped().where("node is not null")
    best = full.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("m"))
    copies = full.groupBy("doc_id", "node").agg(F.count("*").alias("n"))
    id_, node, n = (C.spare(docs.columns, c) for c in ("id", "node", "n"))
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))
    kept = best.select(key("m.doc_id").alias(id_), F.col("m.node").alias(node)).join(copies.select(key("doc_id").alias(id_), F.col("node").alias(node), F.col("n").alias(n)), [id_, node])
    rows = docs.withColumns({id_: key("doc_id"), node: F.unhex(F.md5(F.col("text").cast("string")))})
    found = rows.where(F.col(node).isNotNull()).join(kept, [id_, node])
    once = found.where(F.col(n) == 1).select(*docs.columns)
    row = F.struct(*docs.columns)
    often = found.where(F.col(n) > 1).groupBy(id_, node).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return once.unionByName(often).unionByName(docs.where("text is null"))
