"""Logical column types: what a table declares, how wide it is, and how Spark stores it."""

from __future__ import annotations

import datetime
import decimal
import json
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import types as T

# Bytes a value takes, by tag.
FIXED_SIZES = {
    "u8": 1, "u16": 2, "u32": 4, "u64": 8, "i8": 1, "i16": 2, "i32": 4, "i64": 8, "i128": 16,
    "f32": 4, "f64": 8, "decimal": 16, "bool": 1, "date": 4, "time": 8, "datetime": 8, "duration": 8,
}
STRING_LIKE = ("binary", "string", "keyword")
NESTED = ("list", "array", "struct")
_PYTHON: dict[str, type] = {
    "f32": float, "f64": float, "decimal": decimal.Decimal, "bool": bool, "date": datetime.date, "time": datetime.time,
    "datetime": datetime.datetime, "duration": datetime.timedelta, "binary": bytes, "string": str, "keyword": str,
}


@dataclass(frozen=True)
class LogicalType:
    """A type by tag; the other fields hold where the tag has them."""

    tag: str
    size: int | None = None  # mono: bytes
    precision: int | None = None  # decimal
    scale: int | None = None
    unit: str | None = None  # datetime, duration: ms or us
    tz: str | None = None  # datetime
    inner: LogicalType | None = None  # list, array
    width: int | None = None  # array
    fields: tuple[tuple[str, LogicalType], ...] = ()  # struct

    def __post_init__(self) -> None:
        if self.tag not in FIXED_SIZES and self.tag not in (*STRING_LIKE, *NESTED, "mono"):
            raise TypeError(f"unknown type {self.tag!r}")
        if self.tag == "mono" and self.size not in (4, 8, 16):
            raise ValueError(f"a monotonic column has 4, 8 or 16 bytes, not {self.size}")

    def fallback(self) -> LogicalType:
        """The plain type that stores a keyword or a monotonic column."""
        if self.tag == "keyword":
            return String
        if self.tag == "mono":
            return LogicalType({4: "u32", 8: "u64", 16: "i128"}[self.size])
        return self

    def to_spark(self, narrow_u64: bool = False) -> T.DataType:
        """narrow_u64 stores unsigned 64-bit numbers as bigint, where they are known to fit."""
        match self.fallback().tag:
            case "u8" | "i16":
                return T.ShortType()
            case "i8":
                return T.ByteType()
            case "u16" | "i32":
                return T.IntegerType()
            case "u32" | "i64":
                return T.LongType()
            case "u64":
                return T.LongType() if narrow_u64 else T.DecimalType(20, 0)
            case "i128":
                return T.DecimalType(38, 0)
            case "f32":
                return T.FloatType()
            case "f64":
                return T.DoubleType()
            case "decimal":
                return T.DecimalType(self.precision or 38, self.scale or 0)
            case "bool":
                return T.BooleanType()
            case "date":
                return T.DateType()
            case "time":
                return T.TimeType(6)
            case "datetime":
                return T.TimestampType() if self.tz else T.TimestampNTZType()
            case "duration":
                return T.DayTimeIntervalType()
            case "binary":
                return T.BinaryType()
            case "string":
                return T.StringType()
            case "list" | "array":
                return T.ArrayType(self.inner.to_spark(narrow_u64))
            case "struct":
                return T.StructType([T.StructField(n, t.to_spark(narrow_u64)) for n, t in self.fields])
        raise TypeError(f"no Spark type for {self.tag!r}")

    def encode(self) -> dict[str, Any]:
        out: dict[str, Any] = {"tag": self.tag}
        for name in ("size", "precision", "scale", "unit", "tz", "width"):
            if getattr(self, name) is not None:
                out[name] = getattr(self, name)
        if self.inner is not None:
            out["inner"] = self.inner.encode()
        if self.fields:
            out["fields"] = [[n, t.encode()] for n, t in self.fields]
        return out

    @staticmethod
    def decode(x: dict[str, Any] | str | LogicalType) -> LogicalType:
        if isinstance(x, LogicalType):
            return x
        if isinstance(x, str):
            return LogicalType(x)
        x = dict(x)
        if "inner" in x:
            x["inner"] = LogicalType.decode(x["inner"])
        if "fields" in x:
            x["fields"] = tuple((n, LogicalType.decode(t)) for n, t in x["fields"])
        return LogicalType(**x)

    def __str__(self) -> str:
        given = [str(v) for v in (self.size, self.precision, self.scale, self.unit, self.tz, self.inner, self.width) if v is not None]
        return self.tag + (f"({', '.join(given)})" if given else "")


UInt8, UInt16, UInt32, UInt64 = (LogicalType(t) for t in ("u8", "u16", "u32", "u64"))
Int8, Int16, Int32, Int64, Int128 = (LogicalType(t) for t in ("i8", "i16", "i32", "i64", "i128"))
Float32, Float64, Boolean, Date, Time = (LogicalType(t) for t in ("f32", "f64", "bool", "date", "time"))
Binary, String, Keyword = (LogicalType(t) for t in STRING_LIKE)


def Mono(size: int = 8) -> LogicalType:  # noqa: N802
    return LogicalType("mono", size=size)


def Datetime(unit: str = "us", tz: str | None = None) -> LogicalType:  # noqa: N802
    return LogicalType("datetime", unit=unit, tz=tz)


def Duration(unit: str = "us") -> LogicalType:  # noqa: N802
    return LogicalType("duration", unit=unit)


def Decimal(precision: int = 38, scale: int = 0) -> LogicalType:  # noqa: N802
    return LogicalType("decimal", precision=precision, scale=scale)


def List(inner: LogicalType) -> LogicalType:  # noqa: N802
    return LogicalType("list", inner=inner)


def Array(inner: LogicalType, width: int) -> LogicalType:  # noqa: N802
    return LogicalType("array", inner=inner, width=width)


def Struct(**fields: LogicalType) -> LogicalType:  # noqa: N802
    return LogicalType("struct", fields=tuple(fields.items()))


@dataclass(frozen=True)
class TypeHints:
    """What a writer may use: nullability, uniqueness, order, dictionary, average sizes."""

    optional: bool = False
    unique: bool = False
    sort: str | None = None  # asc or desc
    use_dictionary: bool | None = None
    avg_str_size: int = 0
    avg_list_size: int = 0
    nested: TypeHints | None = None

    def __post_init__(self) -> None:
        if self.sort not in (None, "asc", "desc"):
            raise ValueError(f"sort is asc, desc or None, not {self.sort!r}")

    def encode(self) -> dict[str, Any]:
        return {k: v for k, v in asdict(self).items() if v not in (None, False, 0)}

    @staticmethod
    def decode(x: dict[str, Any] | TypeHints | None) -> TypeHints:
        if isinstance(x, TypeHints):
            return x
        x = dict(x or {})
        if x.get("nested"):
            x["nested"] = TypeHints.decode(x["nested"])
        return TypeHints(**x)


def is_fixed_size(t: LogicalType) -> bool:
    return t.tag in FIXED_SIZES or t.tag == "mono"


def is_logical(t: LogicalType) -> bool:
    """True for types that Spark has no type of its own for."""
    return t.tag in ("keyword", "mono")


def fixed_size(t: LogicalType) -> int | None:
    return FIXED_SIZES.get(t.fallback().tag)


def avg_size(t: LogicalType, hints: TypeHints = TypeHints()) -> int:
    """Estimated bytes a value takes; a list takes 8 and its values, a string 8 and its average size."""
    if t.tag in NESTED:
        inner = hints.nested or hints
        if t.tag == "struct":
            return 8 + sum(avg_size(f, inner) for _, f in t.fields)
        return 8 + avg_size(t.inner, inner) * hints.avg_list_size
    fixed = fixed_size(t)
    return fixed if fixed is not None else 8 + hints.avg_str_size


def kind(t: LogicalType) -> str:
    return "nested" if t.tag in NESTED else "numeric" if is_fixed_size(t) else "string"


def wants_dictionary(t: LogicalType) -> bool:
    return t.tag in ("string", "keyword")


def python_type(t: LogicalType, hints: TypeHints = TypeHints()) -> Any:
    """The Python type of a value; with hints.optional it may be None."""
    if t.tag == "struct":
        out: Any = dict
    elif t.tag in ("list", "array"):
        out = list[python_type(t.inner, hints.nested or TypeHints())]
    else:
        out = _PYTHON.get(t.fallback().tag, int)
    return out | None if hints.optional else out


def dumps(x: Any) -> str:
    """JSON in which dates, times and sets keep their values."""

    def other(v: Any) -> Any:
        if isinstance(v, datetime.datetime | datetime.date | datetime.time):
            return v.isoformat()
        if isinstance(v, set | frozenset | tuple):
            return sorted(v) if isinstance(v, set | frozenset) else list(v)
        if hasattr(v, "encode"):
            return v.encode()
        raise TypeError(f"no JSON for {type(v).__name__}")

    return json.dumps(x, default=other, sort_keys=True)
