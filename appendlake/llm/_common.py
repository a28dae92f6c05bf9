"""Shared parts of the corpus operators: scratch tables, word hashing, grouping.

Everything that leaves a task goes through Spark's own readers and writers, so
that a lost executor costs a recomputation and never a file.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Arrow batch and one numpy chunk may hold (a longer text makes a chunk of its own).
BATCH_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20

#: Rows up to which a small table (rates, benchmark blocks) is broadcast; each use counts them first.
FEW = 10_000

_U = np.uint64
_MIX1, _MIX2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, with Arrow batches bounded by bytes from then on."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, however long single texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    # Workers import this package from where the driver has it, unless it is installed or shipped otherwise.
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH")]))


@contextmanager
def unmeasured(spark: SparkSession) -> Iterator[None]:
    """For rows of a few numbers: batches are bounded by their rows alone, and Spark need not measure a batch with each row."""
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 1))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


# --- scratch -----------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; a folder under the warehouse only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def remove(spark: SparkSession, path: str) -> None:
    fs, jpath = _fs(spark, path)
    fs.delete(jpath, True)


def give_back(spark: SparkSession) -> None:
    """Hands memory that the driver's JVM and Python have freed back to the system.

    Both allocate by malloc beside their heaps (compilers, buffers, threads), which keeps what is freed: over a
    session of many plans some 200 MB. Where libc or the JVM has no such command, nothing is done.
    """
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another libc
        pass
    jvm, kind = spark._jvm, spark._jvm.java.lang.Class.forName

    def array(of: str, *values: object) -> object:
        out = spark.sparkContext._gateway.new_array(getattr(jvm.java.lang, of), len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    server, name = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), "com.sun.management:type=DiagnosticCommand"
    # By its interface, since the server's own class isn't public.
    invoke = kind("javax.management.MBeanServer").getMethod("invoke", array("Class", *map(kind, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))))
    try:
        invoke.invoke(server, array("Object", jvm.javax.management.ObjectName(name), "systemTrimNativeHeap", array("Object"), array("String")))
    except Py4JJavaError:  # a JVM before 17.0.9, or of another system or vendor
        return


class Scratch:
    """Tables written to the shared folder: lineage ends there and any executor can read them again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._quiet_remove)

    def _quiet_remove(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                remove(self.spark, self.root)
            except Exception:  # noqa: BLE001  the JVM may have gone first at exit
                return

    def save(self, df: DataFrame, name: str) -> DataFrame:
        # No marker of success: nothing looks for it, and on a local disk the driver starts commands to write one.
        df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{self.root}/{name}")
        give_back(self.spark)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Removes a table that no later step reads; shuffle files of the steps behind it go with them, not when memory runs low."""
        remove(self.spark, f"{self.root}/{name}")
        self.settle()

    def settle(self) -> None:
        gc.collect()
        self.spark._jvm.System.gc()
        give_back(self.spark)


def spare(columns: list[str], name: str) -> str:
    """A column name that isn't taken, whatever its case."""
    taken = {c.lower() for c in columns}
    return next(f"{name}{'_' * i}" for i in range(1, len(taken) + 2) if f"{name}{'_' * i}" not in taken)


# --- words -------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


_TABLE = mix64(np.arange(1, 257, dtype=_U) * _GOLD)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, CHUNK_BYTES * 2), base, _U)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


@dataclass
class Chunk:
    """Some consecutive texts as bytes; words are runs without ASCII white space and end with their text."""

    lo: int  # rows lo..hi of the batch
    hi: int
    data: np.ndarray
    offs: np.ndarray  # byte offset of each text, one more at the end
    starts: np.ndarray  # of words
    ends: np.ndarray
    first: np.ndarray  # first word of each text, one more at the end

    def hashes(self) -> np.ndarray:
        """64 bits a word: a polynomial over the bytes from prefix sums, then mixed with the length."""
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, _U)
        total = np.zeros(n + 1, _U)
        np.cumsum(_TABLE[self.data] * _power(_BASE, n), out=total[1:])
        h = (total[self.ends] - total[self.starts]) * _power(_INV, n)[self.starts]
        return mix64(h + (self.ends - self.starts).astype(_U) * _GOLD)

    def docs_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*b"!\"'(),-./:;?[]_{}`|<>#*$%&+=~^@\\"]] = 32


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-cases ASCII and Latin-1 letters and turns ASCII punctuation into spaces; lengths stay."""
    out = _FOLD[data]
    upper = np.zeros(len(data), bool)
    upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[upper] += 32
    return out


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES, folded: bool = False) -> Iterator[Chunk]:
    """Cuts a column of texts (null: empty) into chunks of at most limit bytes, or of one text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    buf = texts.buffers()
    offs = np.frombuffer(buf[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None and buf[2].size else np.zeros(0, np.uint8)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        part, own = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        part = fold(part) if folded else part
        white = _WHITE[part]
        before, after = np.ones(len(part), bool), np.ones(len(part), bool)
        before[1:], after[:-1] = white[:-1], white[1:]
        inner = own[:-1][own[:-1] < len(part)]
        before[inner] = True
        inner = own[1:][own[1:] > 0]
        after[inner - 1] = True
        starts, ends = np.flatnonzero(~white & before), np.flatnonzero(~white & after) + 1
        yield Chunk(lo, hi, part, own, starts, ends, np.searchsorted(starts, own))
        lo = hi


_SHINGLE = mix64(np.arange(101, 165, dtype=_U) * _GOLD) | _U(1)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of k words inside a text, their text, and their first word.

    A text of 1 to k-1 words has one window, all its words.
    """
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    s = np.zeros(0, _U)
    if len(h) >= k:
        s = h[: len(h) - k + 1] * _SHINGLE[0]
        for t in range(1, k):
            s += h[t : len(h) - k + 1 + t] * _SHINGLE[t]
        s = mix64(s)
    at = np.arange(len(s))
    inside = at + k <= first[1:][doc[: len(s)]] if len(s) else np.zeros(0, bool)
    s, at = s[inside], at[inside]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.zeros(len(short), _U)
        for t in range(k - 1):
            there = n[short] > t
            extra[there] += h[first[short[there]] + t] * _SHINGLE[t]
        s, at = np.concatenate([s, mix64(extra + n[short].astype(_U))]), np.concatenate([at, first[short]])
        order = np.argsort(at, kind="stable")
        s, at = s[order], at[order]
    return s, doc[at] if len(at) else np.zeros(0, np.int64), at


def word_hashes(text: str | None) -> np.ndarray:
    """The words of one text, hashed."""
    return next(chunks(pa.array([text or ""]), 1 << 62)).hashes()


def code_points(data: np.ndarray) -> np.ndarray:
    """Marks the bytes that begin a code point."""
    return (data & 0xC0) != 0x80


def per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts a mask over bytes for each text."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


# --- groups ------------------------------------------------------------------


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a partition to (node, least node that they lead to), one for each node that isn't the least."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    edges = pa.Table.from_batches(held)
    ends = pa.concat_arrays([c for n in ("u", "v") for c in edges.column(n).chunks])
    names = ends.unique()
    names = names.take(pc.sort_indices(names))  # a node's number is its place in order
    at = pc.index_in(ends, names).to_numpy()
    u, v = at[: edges.num_rows], at[edges.num_rows :]
    root = np.arange(len(names))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]
    node = np.flatnonzero(root != np.arange(len(root)))
    for lo in range(0, len(node), 65_536):
        part = node[lo : lo + 65_536]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(part)), names.take(pa.array(root[part]))], names=["u", "v"])


def components(scratch: Scratch, edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, comp) for the nodes of edges(a, b); comp is the least node that a path reaches.

    Each partition's edges are first made a forest of stars. A round brings a node's edges together, makes
    forests again, and leads each node to its root's root; it ends when every node has one root that has none.
    Rounds write their edges, so a lost executor repeats one step. A partition has at most a node's edges
    to the roots of other partitions together, never a star's members. More than `rounds` rounds are an error.
    """
    kind = next(f.dataType.simpleString() for f in edges.schema.fields if f.name == "a")
    forest = lambda df: df.mapInArrow(_forest, f"u {kind}, v {kind}")
    now, last = scratch.save(forest(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))), f"{name}-0"), f"{name}-0"
    for i in range(1, rounds):
        by_node = now.select("u", F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
        if by_node.groupBy("u").agg(F.sum("as_u").alias("us"), F.max("as_v").alias("vs")).where("us + vs > 1 and us > 0").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        one = scratch.save(forest(now.repartition("u")), f"{name}-{i}a")
        up = one.select(F.col("u").alias("p"), F.col("v").alias("r")).groupBy("p").agg(F.min("r").alias("r"))
        # Where a root has a root, both edges are kept apart: the node goes to the upper one, and the root has its own edge.
        now = scratch.save(one.join(up, one["v"] == up["p"], "left").select("u", F.coalesce("r", "v").alias("v")), f"{name}-{i}")
        for old in (last, f"{name}-{i}a"):
            remove(scratch.spark, f"{scratch.root}/{old}")
        last = f"{name}-{i}"
    raise RuntimeError(f"no fixed point after {rounds} rounds")
