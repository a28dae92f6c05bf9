"""Row builders: rows of Python values become typed frames of an exact size."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import astuple, is_dataclass
from decimal import Decimal
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commit import sort_columns
from .dedupe import Greedy, anti_existing, greedy_unique

if TYPE_CHECKING:
    from ..table import Table


class TableBuilder:
    """Gathers rows on the driver, so it holds one frame's rows at most between flushes.

    scope: 'session' keeps rows unique within this builder; 'table' drops on flush
    what the table has stored too.
    """

    def __init__(self, table: Table, scope: str = "session"):
        if scope not in ("session", "table"):
            raise ValueError(f"scope is session or table, not {scope!r}")
        self.table, self.scope, self.buffer = table, scope, []
        self.unique = [i for i, c in enumerate(table.schema.columns) if c.hints.unique]
        self.greedy = Greedy(self.unique)

    def append(self, row: Sequence | Any) -> bool:
        """False if the row repeats a unique value and was dropped."""
        row = astuple(row) if is_dataclass(row) else tuple(row)
        if self.unique and len(row) == len(self.table.schema.columns) and not self.greedy.accept(row):
            return False
        self.buffer.append(row)
        return True

    def extend(self, rows: Iterable) -> int:
        """How many rows were taken; repeats inside the batch are dropped as well."""
        return sum(self.append(r) for r in rows)

    def rows(self) -> int:
        return len(self.buffer)

    def flush(self, target: int | None = None, allow_underfilled: bool = False, drain: bool = False) -> DataFrame | None:
        """A frame of exactly `target` rows, or of all of them without a target; None where there is nothing to give.

        Fewer rows than the target: with drain they are given, with allow_underfilled
        they stay, else it is an error. A null in a column that isn't optional is an
        error too, and the buffer stays as it was.
        """
        names = self.table.schema.names
        if not self.buffer:
            return None
        if any(len(r) != len(names) for r in self.buffer):
            raise ValueError(f"rows of {self.table.name} have {len(names)} values")
        n = len(self.buffer)
        if target is not None and n < target and not drain:
            if allow_underfilled:
                return None
            raise ValueError(f"{n} rows, {target} are needed")
        n = n if target is None else min(n, target)
        rows = self.buffer[:n]
        for i, c in enumerate(self.table.schema.columns):
            if not c.hints.optional and any(r[i] is None for r in rows):
                raise ValueError(f"column {c.name} has nulls and isn't optional")
        wide = [i for i, f in enumerate(self.table.struct.fields) if isinstance(f.dataType, T.DecimalType)]
        if wide:  # whole numbers wider than Spark's bigint are stored as decimals
            rows = [tuple(Decimal(v) if i in wide and isinstance(v, int) else v for i, v in enumerate(r)) for r in rows]
        df = self.table.spark.createDataFrame(rows, self.table.struct)
        if order := sort_columns(self.table):
            df = df.sortWithinPartitions(*order) if df.rdd.getNumPartitions() == 1 else df.orderBy(*order)
        if self.scope == "table" and self.unique and self.table.exists:
            df = anti_existing(df, self.table.scan(), [names[i] for i in self.unique])
        self.buffer = self.buffer[n:]
        return df


def checked(df: DataFrame, table: Table, order: list[str], scope: str = "session") -> DataFrame:
    """A DataFrame as a builder would pass it: unique by the hints in the order given, without what the table has if scope is 'table'."""
    unique = [c.name for c in table.schema.columns if c.hints.unique]
    if unique:
        df = greedy_unique(df, unique, order)
        if scope == "table" and table.exists:
            df = anti_existing(df, table.scan(), unique)
    return df


def null_audit(df: DataFrame, table: Table) -> DataFrame:
    """One row: nulls of each column that isn't optional."""
    return df.agg(*(F.count_if(F.col(f"`{c.name}`").isNull()).alias(f"null_{c.name}") for c in table.schema.columns if not c.hints.optional))
