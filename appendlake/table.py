"""Tables: declared columns over numbered part files in Hive folders, scanned as DataFrames."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.keys import _quoted
from .operators.commit import TableWriter, WriterOptions
from .plans.partitioning import Partition
from .schema import Schema
from .sources import remote
from .sources.files import data_root, format_from_path, scan_files
from .sources.fs import Entry, Files
from .types import dumps

_KEEP: Any = object()
_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}


class Table:
    """name, source (a path, relative to datadir, or a URL), columns, and how it is stored."""

    def __init__(
        self,
        spark: SparkSession,
        name: str,
        source: Any,
        schema: Any,
        *,
        format: str | None = None,
        compression: str = "zstd",
        compression_level: int | None = None,
        prefix: str | None = None,
        suffix: str | None = None,
        datadir: str | None = None,
        partitioning: Partition | dict | None = None,
        writer_opts: WriterOptions | dict | None = None,
        narrow_u64: bool = False,
        opener: Any = remote.open_url,
    ):
        self.spark, self.name, self.source, self.opener = spark, name, str(source), opener
        self.schema = Schema.of(schema)
        self.remote = remote.is_remote(self.source)
        if format is None:
            try:
                format = format_from_path(self.source)
            except ValueError:
                format = "parquet"
        self.format, self.compression, self.prefix, self.suffix = format, compression, prefix, suffix or format
        self.datadir = str(datadir or data_root()).rstrip("/")
        where = f"remote/{name}" if self.remote else self.source
        self.path = where.rstrip("/") if where.startswith("/") or "://" in where or where.startswith("file:") else f"{self.datadir}/{where}".rstrip("/")
        strings, nested = len(self.schema.string_columns), len(self.schema.nested_columns)
        self._level = compression_level
        self.compression_level = compression_level if compression_level is not None or compression == "uncompressed" else 10 if nested or strings > len(self.schema.columns) / 2 else 6
        self.partitioning = Partition.decode(partitioning) if partitioning is not None else None
        if self.partitioning:
            self.partitioning.check(self.schema)
        self.options = WriterOptions(**writer_opts) if isinstance(writer_opts, dict) else writer_opts or WriterOptions()
        self.narrow_u64, self.files_api = narrow_u64, Files(spark)
        self.struct = self.schema.to_spark(narrow_u64)
        self.key_types = self.partitioning.key_types() if self.partitioning else {}
        self.struct_with_keys = T.StructType([*self.struct.fields, *(T.StructField(k, _TYPES[v]) for k, v in self.key_types.items())])
        self._frame: DataFrame | None = None

    # -- files

    def part_file(self, index: int) -> str:
        return "-".join(filter(None, [self.prefix, f"{index:05d}.{self.suffix}"]))

    @property
    def file_pattern(self) -> str:
        return "-".join(filter(None, [self.prefix, f"*.{self.suffix}"]))

    def part_index(self, name: str) -> int | None:
        body = name.removeprefix(f"{self.prefix}-") if self.prefix else name
        number = body.removesuffix(f".{self.suffix}")
        return int(number) if number != body and number.isdigit() else None

    def files_entries(self) -> list[Entry]:
        if self.remote:
            return self.files_api.walk(self.path)
        return [e for e in self.files_api.walk(self.path) if e.name.endswith(f".{self.suffix}")]

    def files(self) -> list[str]:
        """Sorted data files, without what is staged."""
        return sorted(e.path for e in self.files_entries())

    @property
    def exists(self) -> bool:
        """True if there are data files."""
        return self.files_api.first(self.path, "" if self.remote else f".{self.suffix}") is not None

    @property
    def disk_size(self) -> int:
        return sum(e.size for e in self.files_entries())

    # -- reading

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.struct if self.format == "csv" else self.struct_with_keys)

    def forget(self) -> None:
        """Drops the remembered scan; commits do so."""
        self._frame = None

    def scan(self, use_cache: bool = True, exact_keys: bool = False, refresh: bool = False) -> DataFrame:
        """All rows, with the keys as columns (not of csv). exact_keys derives them from the data, which tells '' from null; refresh asks a remote table's server again."""
        if self._frame is None or not use_cache or refresh:
            self._frame = self._scan(refresh)
        frame = self._frame
        if exact_keys and self.partitioning and self.partitioning.tag != "rowlen":
            frame = self.with_keys(frame.select(*self.struct.fieldNames()), None, stored=True)
        return frame

    def _scan(self, refresh: bool) -> DataFrame:
        if self.remote:
            if refresh or not self.exists:
                got = remote.fetch(self.source, self.path, opener=self.opener)
                if refresh:
                    for e in self.files_entries():
                        if e.name != got.name:
                            self.files_api.remove(e.path)
            return scan_files(self.spark, self.files(), self.format, self.struct)
        if not self.exists:
            return self.empty()
        if not self.partitioning:
            return scan_files(self.spark, self.path, self.format, self.struct)
        if self.format == "csv":
            return scan_files(self.spark, self.path, "csv", self.struct_with_keys).select(*self.struct.fieldNames())
        return scan_files(self.spark, self.path, self.format, self.struct_with_keys, base=self.path)

    def where(self, column: str, op: str, value: Any) -> DataFrame:
        """Rows with `column op value` (=, <, <=, >, >=, prefix), reading the folders only that can hold them."""
        c = F.col(_quoted(column))
        data = c.startswith(value) if op == "prefix" else {"=": c == value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]
        frame, key = self.scan(), None
        if self.partitioning and self.format != "csv" and self.partitioning.column(self.schema).name == column:
            key = self.partitioning.implied(self.schema, op, value)
        return frame.where(data if key is None else key & data)

    def lookup(self, column: str, value: Any) -> DataFrame:
        return self.where(column, "=", value)

    def between(self, column: str, low: Any, high: Any) -> DataFrame:
        frame, c = self.scan(), F.col(_quoted(column))
        out = (c >= low) & (c <= high)
        if self.partitioning and self.format != "csv" and self.partitioning.column(self.schema).name == column:
            for op, v in ((">=", low), ("<=", high)):
                key = self.partitioning.implied(self.schema, op, v)
                out = out if key is None else key & out
        return frame.where(out)

    # -- writing

    def with_keys(self, df: DataFrame, rows: int | None, stored: bool = False) -> DataFrame:
        if not self.partitioning:
            return df
        if stored and self.partitioning.tag == "rowlen":
            raise ValueError("row-length keys can't be derived from stored rows")
        return df.withColumns(self.partitioning.keys(self.schema, rows))

    def writer(self, ordered: bool = False, break_lock: bool = False) -> TableWriter:
        return TableWriter(self, ordered, break_lock)

    def append(self, df: DataFrame) -> None:
        """Commits one frame."""
        with self.writer() as w:
            w.stage_frame(df)

    # -- metadata

    def copy(self, **changes: Any) -> Table:
        """The same table with some arguments changed, to None if so given."""
        args = {
            "name": self.name, "source": self.source, "schema": self.schema, "format": self.format, "compression": self.compression, "compression_level": self._level, "prefix": self.prefix,
            "suffix": self.suffix, "datadir": self.datadir, "partitioning": self.partitioning, "writer_opts": self.options, "narrow_u64": self.narrow_u64, "opener": self.opener,
        }
        return Table(self.spark, **(args | changes))

    def encode(self) -> dict[str, Any]:
        return {
            "name": self.name, "source": self.source, "schema": self.schema.encode(), "format": self.format, "compression": self.compression, "compression_level": self._level, "prefix": self.prefix,
            "suffix": self.suffix, "partitioning": self.partitioning.encode() if self.partitioning else None, "writer_opts": self.options.encode(), "narrow_u64": self.narrow_u64,
        }

    def to_json(self) -> str:
        return dumps(self.encode())

    @staticmethod
    def decode(spark: SparkSession, x: Any, **more: Any) -> Table:
        """From a Table, its encoded dict or its JSON."""
        if isinstance(x, Table):
            return x
        return Table(spark, **((json.loads(x) if isinstance(x, str) else x) | more))

    def row_class(self) -> type:
        return self.schema.row_class(self.name)

    def pretty_str(self) -> str:
        how = f"{self.format}, {self.compression}" + (f" {self.compression_level}" if self.compression_level is not None else "")
        keys = f", by {', '.join(self.key_types)}" if self.key_types else ""
        return f"Table {self.name} at {self.path} ({how}{keys})\n{self.schema.pretty_str()}"

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Table) and self.encode() == other.encode()

    def __hash__(self) -> int:
        return hash(self.to_json())
