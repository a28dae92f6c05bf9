"""Partition specs. Each turns a column into Hive keys, and a predicate on the column into one on the keys.

A key predicate is only ever added to the predicate on the data, never put in its
place: it prunes directories, and the data predicate decides. A derived key that
is empty or null lives in the default partition and implies nothing.
"""

from __future__ import annotations

import datetime
import warnings
from dataclasses import asdict, dataclass
from typing import Any, ClassVar
from zoneinfo import ZoneInfo

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from ..errors import AppendlakeWarning, TableLayoutError
from ..functions.keys import _quoted, char_keys, mono_bucket, padded_number, time_keys
from ..schema import Column, Schema
from ..types import NESTED


@dataclass(frozen=True)
class Partition:
    """on_column: a position or a name."""

    tag: ClassVar[str] = ""
    on_column: int | str = 0

    def column(self, schema: Schema) -> Column:
        if isinstance(self.on_column, int):
            return schema.columns[self.on_column]
        if self.on_column not in schema.names:
            raise ValueError(f"no column {self.on_column!r} in {schema}")
        return schema[self.on_column]

    def key_types(self) -> dict[str, str]:
        raise NotImplementedError

    def keys(self, schema: Schema, rows: int | None = None) -> dict[str, SparkColumn]:
        """Key expressions; rows: how many the staged frame has, which only RowLenPartition needs."""
        raise NotImplementedError

    def check(self, schema: Schema) -> None:
        """Raises TableLayoutError where the spec doesn't fit; a declared column named like a key doesn't."""
        clash = set(self.key_types()) & set(schema.names)
        if clash:
            raise TableLayoutError(f"columns {sorted(clash)} are named like partition keys")
        self.column(schema)

    def implied(self, schema: Schema, op: str, value: Any) -> SparkColumn | None:
        """A predicate on the keys that follows from `column op value`; op: =, <, <=, >, >=, prefix."""
        return None

    def encode(self) -> dict[str, Any]:
        return {"type": self.tag, **asdict(self)}

    @staticmethod
    def decode(x: dict[str, Any] | Partition) -> Partition:
        if isinstance(x, Partition):
            return x
        x = dict(x)
        kinds = {k.tag: k for k in (RowLenPartition, MonoPartition, TimePartition, DictionaryPartition)}
        return kinds[x.pop("type")](**x)


@dataclass(frozen=True)
class RowLenPartition(Partition):
    """bucket = rows of the staged frame // row_size: one number for each frame."""

    tag: ClassVar[str] = "rowlen"
    row_size: int = 100_000

    def key_types(self) -> dict[str, str]:
        return {"bucket": "bigint"}

    def keys(self, schema: Schema, rows: int | None = None) -> dict[str, SparkColumn]:
        if rows is None:
            raise ValueError("RowLenPartition needs the number of rows of the frame")
        return {"bucket": F.lit(rows // self.row_size).cast("bigint")}


@dataclass(frozen=True)
class MonoPartition(Partition):
    """bucket = value // row_size of a monotonic column."""

    tag: ClassVar[str] = "mono"
    row_size: int = 100_000

    def check(self, schema: Schema) -> None:
        super().check(schema)
        if self.column(schema).type.tag != "mono":
            raise TableLayoutError(f"column {self.column(schema).name} isn't monotonic")

    def key_types(self) -> dict[str, str]:
        return {"bucket": "bigint"}

    def keys(self, schema: Schema, rows: int | None = None) -> dict[str, SparkColumn]:
        c = self.column(schema)
        return {"bucket": mono_bucket(c.name, self.row_size, decimal=c.type.size != 4)}

    def implied(self, schema: Schema, op: str, value: Any) -> SparkColumn | None:
        if value is None or op == "prefix":
            return None
        bucket, key = int(value) // self.row_size, F.col("bucket")
        return {"=": key == bucket, "<": key <= bucket, "<=": key <= bucket, ">": key >= bucket, ">=": key >= bucket}[op]


_TIME_KINDS = {"year": ("year",), "month": ("month",), "day": ("day",), "year-month": ("year", "month"), "year-month-day": ("year", "month", "day")}


@dataclass(frozen=True)
class TimePartition(Partition):
    """year, month and day keys of a date or datetime; month or day alone merge years.

    An instant's keys are those in its column's zone, of writers and of lookups alike, whatever the session's is.
    """

    tag: ClassVar[str] = "time"
    kind: str = "year"

    @property
    def parts(self) -> tuple[str, ...]:
        try:
            return _TIME_KINDS[self.kind.replace("_", "-")]
        except KeyError:
            raise ValueError(f"unknown kind {self.kind!r}") from None

    def check(self, schema: Schema) -> None:
        super().check(schema)
        if self.column(schema).type.tag not in ("date", "datetime"):
            raise TableLayoutError(f"column {self.column(schema).name} isn't temporal")
        _ = self.parts

    def key_types(self) -> dict[str, str]:
        return dict.fromkeys(self.parts, "int")

    def keys(self, schema: Schema, rows: int | None = None) -> dict[str, SparkColumn]:
        return time_keys(self.column(schema).name, self.parts, self.zone(schema))

    def zone(self, schema: Schema) -> str | None:
        """The zone of an instant's keys; None for dates and zone-less datetimes."""
        kind = self.column(schema).type
        return kind.tz if kind.tag == "datetime" else None

    def implied(self, schema: Schema, op: str, value: Any) -> SparkColumn | None:
        if not isinstance(value, datetime.date) or op == "prefix":
            return None
        zone, aware = self.zone(schema), getattr(value, "tzinfo", None) is not None
        if aware != (zone is not None):
            return None  # what Spark makes of the two depends on the session's zone, so nothing follows for the keys
        if aware:
            value = value.astimezone(ZoneInfo(zone))
        if op == "=":
            out = None
            for p in self.parts:
                one = F.col(p) == getattr(value, p)
                out = one if out is None else out & one
            return out
        if self.parts[0] != "year":
            return None
        year = F.col("year")
        return year <= value.year if op[0] == "<" else year >= value.year


@dataclass(frozen=True)
class DictionaryPartition(Partition):
    """char0, char1, ...: the first characters of a text, or of a number's base-10 digits."""

    tag: ClassVar[str] = "dict"
    depth: int = 1
    pad_to: int | None = None
    lowercase: bool = False
    signed: bool = False

    def check(self, schema: Schema) -> None:
        super().check(schema)
        c = self.column(schema)
        if c.type.tag in NESTED:
            raise TableLayoutError(f"column {c.name} is nested")
        if c.kind == "numeric" and not self.pad_to:
            warnings.warn(f"numbers in {c.name} aren't padded, so that first digits of short and long ones meet", AppendlakeWarning, stacklevel=2)

    def key_types(self) -> dict[str, str]:
        return {f"char{i}": "string" for i in range(self.depth)}

    def text(self, schema: Schema, value: SparkColumn) -> SparkColumn:
        c = self.column(schema)
        if c.kind == "numeric":
            return padded_number(value, self.pad_to, self.signed)
        if c.type.tag == "binary":
            value = F.validate_utf8(value.cast("string"))
        return F.lower(value.cast("string")) if self.lowercase else value.cast("string")

    def keys(self, schema: Schema, rows: int | None = None) -> dict[str, SparkColumn]:
        return char_keys(self.text(schema, F.col(_quoted(self.column(schema).name))), self.depth)

    def _literal(self, schema: Schema, value: Any) -> str | None:
        if self.column(schema).kind != "numeric":
            return (value.lower() if self.lowercase else value) if isinstance(value, str) else None
        if isinstance(value, float):
            return None
        text = str(value if self.signed else abs(value))
        return text.zfill(self.pad_to) if self.pad_to else text

    def implied(self, schema: Schema, op: str, value: Any) -> SparkColumn | None:
        if value is None or op not in ("=", "prefix") or (op == "prefix" and self.column(schema).kind == "numeric"):
            return None
        text, out = self._literal(schema, value), None
        for i in range(min(self.depth, len(text or ""))):
            one = F.col(f"char{i}") == text[i]
            out = one if out is None else out & one
        return out
