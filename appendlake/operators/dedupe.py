"""Exact uniqueness: keep-first, greedy over several columns, and against rows already stored."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bloom_params(n: int, p: float) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter for n items and a false-positive rate p; for sizing reports only, since dedupe here is exact."""
    if n <= 0 or not 0 < p < 1:
        raise ValueError("n must be above 0 and p between 0 and 1")
    bits = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return bits, max(1, round(bits / n * math.log(2)))


def keep_first(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """The first row of each value by order; all rows without a value. Spark limits each group before the shuffle."""
    w = Window.partitionBy(column).orderBy(*order)
    first = df.where(F.col(column).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return first.unionByName(df.where(F.col(column).isNull()))


class Greedy:
    """A row is dropped if any unique column's value was in an accepted row before; only accepted rows count."""

    def __init__(self, positions: Iterable[int]):
        self.seen: list[tuple[int, set]] = [(p, set()) for p in positions]

    def accept(self, row: tuple) -> bool:
        values = [(s, row[p]) for p, s in self.seen]
        if any(v is not None and v in s for s, v in values):
            return False
        for s, v in values:
            if v is not None:
                s.add(v)
        return True


def greedy_unique(df: DataFrame, columns: list[str], order: list[str], rounds: int = 10_000) -> DataFrame:
    """The greedy rule over a distributed frame, in the order given (which must be total).

    One column is keep_first. With several, rounds settle what can be known: a
    row that is the first left for each of its values is accepted, and what shares
    a value with it goes. All rounds are joins and minima, so that no group of rows
    meets in one task; chains of conflicts cost a round each.
    """
    if len(columns) == 1:
        return keep_first(df, columns[0], order)
    from .scratch import Scratch

    scratch = Scratch(df.sparkSession)
    spare = "__row"
    ranked = scratch.save(df.orderBy(*order).withColumn(spare, F.monotonically_increasing_id()), "ranked")
    left, accepted = ranked.select(spare, *columns), None
    for i in range(rounds):
        first = left
        for c in columns:
            low = left.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(spare).alias(f"__first_{c}"))
            first = first.join(low, c, "left")
        ok = first
        for c in columns:
            ok = ok.where(F.col(f"__first_{c}").isNull() | (F.col(f"__first_{c}") == F.col(spare)))
        ok = scratch.save(ok.select(spare, *columns), f"ok-{i}")
        accepted = ok if accepted is None else accepted.unionByName(ok)
        for c in columns:
            left = left.join(ok.select(c).where(F.col(c).isNotNull()).distinct(), c, "left_anti")
        left = scratch.save(left.join(ok.select(spare), spare, "left_anti"), f"left-{i}")
        if left.isEmpty():
            return ranked.join(accepted.select(spare), spare, "left_semi").drop(spare)
    raise RuntimeError(f"conflicts weren't settled in {rounds} rounds")


def anti_existing(df: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    """The rows none of whose unique values is stored already."""
    for c in columns:
        df = df.join(stored.select(c).where(F.col(c).isNotNull()).distinct(), c, "left_anti").select(*df.columns)
    return df
