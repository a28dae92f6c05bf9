"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are grown here on a bounded labelled sample (logistic loss, histogram
splits) and flattened into arrays of nodes, one row a tree, which score all
texts of a chunk at once. Features in docstats.WORSE are constrained: a split on
one gives the side with more of it no higher value, and bounds pass down to both
sides, so that the score never rises with such a feature.

Cases: a null text has no words and fails the base rules, as an empty one does.
Very long texts count whole. Rows that repeat a doc_id are judged one by one; equal
texts tie in everything. Without labels of both kinds the trees keep everything that
passes the base rules. An empty table gives an empty one. Other columns, whatever
their names, don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import docstats as S

TREES, DEPTH, RATE, BINS, LEAF = 60, 4, 0.2, 64, 20
VERDICT = 0.5


class BoostedTrees:
    """monotone: -1, 0 or 1 a feature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = TREES, depth: int = DEPTH):
        self.depth, nodes = depth, 2 ** (depth + 1) - 1
        self.feature = np.zeros((trees, nodes), np.int64)
        self.cut = np.full((trees, nodes), np.inf)  # never exceeded: to the left
        self.value = np.zeros((trees, nodes))
        share = np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6)
        self.start = float(np.log(share / (1 - share)))
        if len(y) == 0 or y.min() == y.max():
            self.start = 20.0
            return
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), self.start)
        for t in range(trees):
            p = 1 / (1 + np.exp(-margin))
            margin += self._grow(t, binned, edges, p - y, p * (1 - p), monotone)

    def _grow(self, t: int, binned: np.ndarray, edges: list, g: np.ndarray, h: np.ndarray, monotone: list[int]) -> np.ndarray:
        node = np.zeros(len(g), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        weight = lambda a, b: -a / (b + 1.0)
        self.value[t, 0] = RATE * float(weight(g.sum(), h.sum()))
        for at in range(2**self.depth - 1):
            mine = np.flatnonzero(node == at)
            if at not in bounds or len(mine) < 2 * LEAF:
                continue
            low, high = bounds[at]
            best = (1e-6, None)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[mine, f]
                n = len(e) + 1
                cg, ch, cn = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (g[mine], h[mine], None))
                tg, th = g[mine].sum(), h[mine].sum()
                left, right = np.clip(weight(cg, ch), low, high), np.clip(weight(tg - cg, th - ch), low, high)
                loss = lambda a, b, v: a * v + 0.5 * (b + 1.0) * v * v
                whole = np.clip(weight(tg, th), low, high)
                gain = loss(tg, th, whole) - loss(cg, ch, left) - loss(tg - cg, th - ch, right)
                gain[(cn < LEAF) | (len(mine) - cn < LEAF)] = -1
                if monotone[f]:
                    gain[monotone[f] * (right - left) < 0] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, left[k], right[k]))
            if best[1] is None:
                continue
            f, k, left, right = best[1]
            self.feature[t, at], self.cut[t, at] = f, edges[f][k]
            middle = (left + right) / 2
            a, b = 2 * at + 1, 2 * at + 2
            bounds[a] = (low, middle) if monotone[f] > 0 else (middle, high) if monotone[f] < 0 else (low, high)
            bounds[b] = (middle, high) if monotone[f] > 0 else (low, middle) if monotone[f] < 0 else (low, high)
            self.value[t, a], self.value[t, b] = RATE * left, RATE * right
            node[mine] = np.where(binned[mine, f] > k, b, a)
        # A node that wasn't split hands its value to the leaves that rows reach by going left.
        for at in range(2**self.depth - 1):
            if np.isinf(self.cut[t, at]):
                self.value[t, 2 * at + 1] = self.value[t, at]
        out = np.zeros(len(g))
        for at in np.unique(node):
            out[node == at] = self.value[t, at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in range(len(self.cut)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            margin += self.value[t, at]
        return 1 / (1 + np.exp(-margin))


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])


def fit(docs: DataFrame, labels: DataFrame) -> BoostedTrees:
    base, x, y = S.labelled(docs, labels, "quality")
    use = ~base_failed(base)
    return BoostedTrees(x[use], y[use], [-(f in S.WORSE) for f in S.FEATURES])


def judge(docs: DataFrame, model: BoostedTrees) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, score for each row of docs(doc_id, text)."""

    def give(base: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        failed, p = base_failed(base), model.probability(x)
        return dict(zip(S.BASE, base.T.copy(), strict=True)) | {"base_failed": failed, "kept": ~failed & (p >= VERDICT), "score": p}

    schema = "doc_id long, " + ", ".join(f"{b} long" for b in S.BASE) + ", base_failed boolean, kept boolean, score double"
    return S.score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), give, schema, ["doc_id"])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, C.table(spark, sf_dir, "labels")))
