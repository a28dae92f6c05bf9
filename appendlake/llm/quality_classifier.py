"""Quality classifier: Bradley-Terry ranking of documents, thresholded at a quantile of the scores.

Each document has a worth w.phi(x); a document labelled 1 is preferred to one
labelled 0 with probability sigmoid of the difference. w is learnt by logistic
loss on differences of features over pairs from all labelled rows, each of which is
in PARTNERS pairs at least. The threshold is the quantile of the rows' worths that
puts the labels right most often; a monotone map then moves it to a score of 0.3.

Labelled rows are dealt to units by the hash of their id, with some UNIT of the rarer
label each, and pairs are made inside a unit. Quantiles, means, Newton's steps and the
threshold are sums over units: TASKS tasks send one array each, however many rows
there are.

Cases: a null text counts as empty and gets a score like any other. Rows that
repeat a doc_id are scored one by one; equal texts tie. Very long texts count whole.
Without labels of both kinds every score is 1, so that nothing is rejected. An empty
table gives an empty one. Other columns, whatever their names, are passed over, and
kept by keep_good.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import docstats as S

CUT = 0.3
PARTNERS, UNIT, TASKS = 4, 500, 32
STEPS, RIDGE = 30, 1e-3
SPAN = [0.001, 0.999]
#: Hinges at quantiles let the worth bend.
HINGES = [0.05, 0.25, 0.5, 0.75, 0.9, 0.97]
BINS = 1 << 14
_U = np.uint64

#: Sums (or joins by another ufunc) an array that is made of (x, y) of every unit.
Total = Callable[..., np.ndarray]


def _ordered(x: np.ndarray) -> np.ndarray:
    """The upper 32 bits of doubles, as whole numbers in the doubles' order."""
    bits = (x + 0.0).view(_U)
    return (np.where(bits >> _U(63), ~bits, bits | _U(1 << 63)) >> _U(32)).astype(np.int64)


def _doubles(key: np.ndarray) -> np.ndarray:
    bits = key.astype(_U) << _U(32)
    return np.where(bits >> _U(63), bits ^ _U(1 << 63), ~bits & _U(0xFFFFFFFF00000000)).view(float)


def quantiles(total: Total, n: int, columns: int, at: list[float]) -> np.ndarray:
    """len(at) x columns: of all rows the values of these ranks, rounded to 32 bits. Each pass counts 8 more bits of what begins as they do."""
    rank = np.repeat(np.floor(np.array(at) * (n - 1)).astype(np.int64)[:, None], columns, axis=1)
    found = np.zeros((len(at), columns), np.int64)
    for shift in (24, 16, 8, 0):

        def count(x: np.ndarray, y: np.ndarray, shift=shift, found=found) -> np.ndarray:
            key = _ordered(x) >> shift
            out = np.zeros((*found.shape, 256), np.int64)
            for q in range(len(found)):
                row, column = np.nonzero(key >> 8 == found[q])
                out[q] = np.bincount(column * 256 + (key[row, column] & 255), minlength=columns * 256).reshape(columns, 256)
            return out

        upto = np.cumsum(total(count), axis=2)
        digit = (upto <= rank[:, :, None]).sum(axis=2)
        rank = rank - np.where(digit, np.take_along_axis(upto, np.maximum(digit - 1, 0)[:, :, None], 2)[:, :, 0], 0)
        found = found * 256 + digit
    return _doubles(found)


def differences(phi: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of a unit: better less worse row for each pair; every row has PARTNERS others, or all that there are."""
    good, bad = phi[y == 1], phi[y == 0]
    if not len(good) or not len(bad):
        return np.zeros((0, phi.shape[1]))
    i, few = np.arange(max(len(good), len(bad))), min(len(good), len(bad))
    turns = [r * max(1, few // PARTNERS) for r in range(min(PARTNERS, few))]
    return np.concatenate([good[(i + t * (len(good) == few)) % len(good)] - bad[(i + t * (len(good) > few)) % len(bad)] for t in turns])


class BradleyTerry:
    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = 0):
        """Of rows in memory, a unit of them; pairs: no longer bounds anything."""
        self.learn(lambda make, join=np.add: make(x, y), x.shape[1], int((y == 0).sum()), int((y == 1).sum()))

    def learn(self, total: Total, columns: int, n_bad: int, n_good: int) -> BradleyTerry:
        n, self.trained = n_bad + n_good, n_bad > 0 and n_good > 0
        if not self.trained:
            return self
        ends = quantiles(total, n, columns, [*SPAN, *HINGES])
        self.low, self.high, self.knots = ends[0], ends[1], ends[2:]
        sums = total(lambda x, y: np.stack([(raw := self._bend(x)).sum(axis=0), (raw**2).sum(axis=0)]))
        self.mean = sums[0] / n
        self.std = np.sqrt(np.maximum(sums[1] / n - self.mean**2, 0)) + 1e-9
        size = len(self.mean)

        def slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
            """Pairs, loss, gradient and curvature."""
            d = differences(self._phi(x), y)
            z = np.clip(d @ w, -500, 500)
            p = 1 / (1 + np.exp(z))
            return np.concatenate([[len(d), np.logaddexp(0, -z).sum()], -(d * p[:, None]).sum(axis=0), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])

        def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            s = total(lambda x, y: slopes(x, y, w))
            s = s / max(s[0], 1)
            return s[1] + RIDGE / 2 * w @ w, s[2 : 2 + size] + RIDGE * w, s[2 + size :].reshape(size, size) + RIDGE * np.eye(size)

        self.w = np.zeros(size)
        loss, gradient, curve = at(self.w)
        for _ in range(STEPS):
            step, whole = np.linalg.solve(curve, gradient), 1.0
            if gradient @ step < 1e-8:
                break
            later = at(self.w - step)
            while later[0] > loss and whole > 1e-3:  # too far
                whole /= 2
                later = at(self.w - whole * step)
            if later[0] > loss:
                break
            self.w, (loss, gradient, curve) = self.w - whole * step, later
        # How many worths of either label are below the edges of BINS equal steps.
        ends = total(lambda x, y: np.array([(worth := self._phi(x) @ self.w).max(initial=-np.inf), -worth.min(initial=np.inf)]), np.maximum)
        low, width = -ends[1], max(1e-12, (ends[0] + ends[1]) / (BINS - 1))

        def count(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            bin_ = np.clip(np.floor((self._phi(x) @ self.w - low) / width).astype(np.int64), 0, BINS - 1)
            return np.stack([np.bincount(bin_[y == k], minlength=BINS) for k in (0, 1)])

        counts = total(count)
        below = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(counts, axis=1)], axis=1)
        grid = np.searchsorted(below.sum(axis=0), np.linspace(0, n, 1001))
        right = (below[0] + n_good - below[1])[grid]
        best = np.flatnonzero(right == right.max())
        k = best[len(best) // 2]
        self.quantile, self.cut = k / 1000, low + width * grid[k]
        apart, many = np.abs(low + width * (np.arange(BINS) + 0.5) - self.cut), counts.sum(axis=0)
        order = np.argsort(apart, kind="stable")
        self.scale = max(1e-9, apart[order][np.searchsorted(np.cumsum(many[order]), n / 2)])
        return self

    def _phi(self, x: np.ndarray) -> np.ndarray:
        return (self._bend(x) - self.mean) / self.std

    def _bend(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, self.low, self.high)
        return np.concatenate([x, *(np.maximum(x - k, 0) for k in self.knots)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.ones(len(x))
        worth = self._phi(x) @ self.w
        z = 3 * (worth - self.cut) / self.scale + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A unit's rows as one, in the order of their ids' hashes."""
    rows = pa.Table.from_batches(batches)
    ids = rows["doc_id"].combine_chunks().to_numpy()
    order = np.argsort(C.mix64(ids.view(_U)), kind="stable")
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order, len(S.BASE) :]
    yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()), pa.array([rows["y"].combine_chunks().to_numpy()[order].astype(np.int32).tobytes()], pa.binary())], names=["x", "y"])


def fit(docs: DataFrame, labels: DataFrame) -> BradleyTerry:
    """Of all labelled rows outside the held-out fold."""
    scratch = C.Scratch(docs.sparkSession, "quality")
    rows = scratch.save(S.all_labelled(docs, labels, "quality").where("y in (0, 1)"), "rows")
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good, columns = n.get(0, 0), n.get(1, 0), len(S.FEATURES)
    if not n_bad or not n_good:
        return BradleyTerry(np.zeros((0, columns)), np.zeros(0, int))
    dealt = rows.withColumn("unit", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, min(n_bad, n_good) // UNIT))))
    units = scratch.save(dealt.groupBy("unit").applyInArrow(_units, "x binary, y binary"), "units")
    scratch.drop("rows")

    def total(make: Callable[[np.ndarray, np.ndarray], np.ndarray], join: np.ufunc = np.add) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                for x, y in zip(b.column("x"), b.column("y"), strict=True):
                    part = make(np.frombuffer(x.as_buffer(), float).reshape(-1, columns), np.frombuffer(y.as_buffer(), np.int32))
                    out = part if out is None else join(out, part)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.dtype.str]), pa.array([list(out.shape)], pa.list_(pa.int32())), pa.array([out.tobytes()], pa.binary())], names=["kind", "shape", "data"])

        got = units.coalesce(TASKS).mapInArrow(run, "kind string, shape array<int>, data binary").toArrow()
        parts = [np.frombuffer(d.as_buffer(), k.as_py()).reshape(s.as_py()) for k, s, d in zip(got["kind"], got["shape"], got["data"], strict=True)]
        return functools.reduce(join, parts)

    model = BradleyTerry.__new__(BradleyTerry).learn(total, columns, n_bad, n_good)
    scratch.drop("units")
    return model


def scored(docs: DataFrame, model: BradleyTerry, schema: str, keep: list[str]) -> DataFrame:
    return S.score_texts(docs, lambda _, x: {"score": model.score(x)}, f"{schema}, score double", keep)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    docs = C.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, C.table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text", S.held_out().alias("held_out")), model, "doc_id long, held_out boolean", ["doc_id", "held_out"])
    return out.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score of at least CUT, all their columns as they were."""
    C.bound_batches(spark)
    model = fit(docs, labels)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    spare = next(f"score{'_' * i}" for i in range(1, 99) if f"score{'_' * i}" not in docs.columns)
    text = docs.withColumn("text", F.col("text").cast("string"))
    out = S.score_texts(text, lambda _, x: {spare: model.score(x)}, f"{schema}, {spare} double", docs.columns)
    return out.where(F.col(spare) >= CUT).drop(spare)
