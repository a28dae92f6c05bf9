"""Columns and schemas: declared types with hints, on top of StructType."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, make_dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import types as T

from . import types as L
from .types import LogicalType, TypeHints

ROW_GROUP_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class Column:
    name: str
    type: LogicalType
    hints: TypeHints = field(default_factory=TypeHints)

    @staticmethod
    def of(x: Any) -> Column:
        """From a Column, (name, type), (name, type, hints) or a dict of them."""
        if isinstance(x, Column):
            return x
        if isinstance(x, dict):
            return Column(x["name"], LogicalType.decode(x["type"]), TypeHints.decode(x.get("hints")))
        name, kind, *hints = x
        return Column(name, LogicalType.decode(kind), TypeHints.decode(hints[0] if hints else None))

    @property
    def kind(self) -> str:
        return L.kind(self.type)

    @property
    def avg_size(self) -> int:
        return L.avg_size(self.type, self.hints)

    @property
    def use_dictionary(self) -> bool:
        return L.wants_dictionary(self.type) if self.hints.use_dictionary is None else self.hints.use_dictionary

    def encode(self) -> dict[str, Any]:
        return {"name": self.name, "type": self.type.encode(), "hints": self.hints.encode()}

    def to_spark(self, narrow_u64: bool = False) -> T.StructField:
        return T.StructField(self.name, self.type.to_spark(narrow_u64), self.hints.optional, {"logical": json.dumps(self.type.encode()), "hints": json.dumps(self.hints.encode())})


class Schema:
    """Columns in order, and the rows that make a row group."""

    def __init__(self, columns: Iterable[Any], *, row_group_size: int | None = None, target_group_size: int = ROW_GROUP_BYTES):
        self.columns = tuple(Column.of(c) for c in columns)
        if not self.columns:
            raise ValueError("a schema has at least one column")
        names = [c.name for c in self.columns]
        if len(set(names)) < len(names):
            raise ValueError(f"a column name comes again in {names}")
        self.avg_row_size = sum(c.avg_size for c in self.columns)
        if row_group_size is None and target_group_size <= 0:
            raise ValueError("target_group_size must be above 0")
        self.row_group_size = row_group_size or max(1, target_group_size // max(1, self.avg_row_size))

    @staticmethod
    def of(x: Any) -> Schema:
        """From a Schema, its encoded dict, columns, or a StructType that a Schema made."""
        if isinstance(x, Schema):
            return x
        if isinstance(x, T.StructType):
            return Schema([(f.name, LogicalType.decode(json.loads(f.metadata["logical"])), TypeHints.decode(json.loads(f.metadata["hints"]))) for f in x.fields])
        if isinstance(x, dict):
            return Schema(x["columns"], row_group_size=x.get("row_group_size"))
        return Schema(x)

    def __len__(self) -> int:
        return len(self.columns)

    def __getitem__(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @cached_property
    def numeric_columns(self) -> tuple[Column, ...]:
        return tuple(c for c in self.columns if c.kind == "numeric")

    @cached_property
    def string_columns(self) -> tuple[Column, ...]:
        return tuple(c for c in self.columns if c.kind == "string")

    @cached_property
    def nested_columns(self) -> tuple[Column, ...]:
        return tuple(c for c in self.columns if c.kind == "nested")

    @cached_property
    def row_type(self) -> type:
        """tuple[...] of the columns' Python types."""
        return tuple[tuple(L.python_type(c.type, c.hints) for c in self.columns)]

    def row_class(self, name: str) -> type:
        """A frozen dataclass with a field for each column, optional ones defaulting to None."""
        required = [(c.name, L.python_type(c.type, c.hints)) for c in self.columns if not c.hints.optional]
        optional = [(c.name, L.python_type(c.type, c.hints), None) for c in self.columns if c.hints.optional]
        return make_dataclass(f"{name.title().replace('_', '')}Row", [*required, *optional], frozen=True, kw_only=True)

    def to_spark(self, narrow_u64: bool = False) -> T.StructType:
        return T.StructType([c.to_spark(narrow_u64) for c in self.columns])

    def encode(self) -> dict[str, Any]:
        return {"columns": [c.encode() for c in self.columns], "row_group_size": self.row_group_size}

    def to_json(self) -> str:
        return L.dumps(self.encode())

    @staticmethod
    def from_json(text: str) -> Schema:
        return Schema.of(json.loads(text))

    def pretty_str(self) -> str:
        out = []
        for c in self.columns:
            marks = [w for w, on in (("optional", c.hints.optional), ("unique", c.hints.unique), (f"sort {c.hints.sort}", c.hints.sort), ("dictionary", c.use_dictionary)) if on]
            out.append(f"  {c.name}: {c.type} [{', '.join([*marks, f'{c.avg_size} B'])}]")
        return "\n".join([f"Schema, {self.avg_row_size:,} B a row, {self.row_group_size:,} rows a group", *out])

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and self.columns == other.columns and self.row_group_size == other.row_group_size

    def __hash__(self) -> int:
        return hash((self.columns, self.row_group_size))

    def __repr__(self) -> str:
        return f"Schema({', '.join(self.names)})"
