"""Part files cut by pyarrow from sorted parquet files, on a disk that the driver and all executors share.

Hadoop's local file system starts a command (chmod) for each file and each folder that
it makes, some 20 ms of a task for a part of a few hundred rows, where pyarrow takes 1 or
2. Rows are read in the order in which they are to lie, so that a part of any size is
written with a row group in memory, without another shuffle or sort.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import Schema

BATCH_ROWS = 1 << 16
_CODECS = {"zstd": "zstd", "snappy": "snappy", "gzip": "gzip", "uncompressed": "none"}
_PLAIN = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)

Piece = tuple[str, int, int]  # rows [lo, hi) of a file


def fits(struct: T.StructType, compression: str) -> bool:
    """Whether pyarrow stores these columns as Spark does."""
    return compression in _CODECS and all(isinstance(f.dataType, _PLAIN) for f in struct.fields)


@dataclass(frozen=True)
class PartWriter:
    """Writes parts below a folder; a task's names are its own, so that what an attempt that failed has left is never met."""

    folder: str
    schema: pa.Schema
    rows_a_group: int
    options: dict[str, Any]

    @staticmethod
    def of(folder: str, schema: Schema, struct: T.StructType, level: int | None, compression: str, version: str) -> PartWriter:
        """The same codec, level, dictionaries and rows a group as parquet_options; pages have checksums, since files have none beside them."""
        fields = [pa.field(f.name, f.type) for f in to_arrow_schema(struct)]
        options = {
            "compression": _CODECS[compression], "compression_level": level if compression == "zstd" else None, "use_dictionary": [c.name for c in schema.columns if c.use_dictionary],
            "store_schema": False, "write_page_checksum": True,
        }
        return PartWriter(folder, pa.schema(fields, {"org.apache.spark.version": version}), schema.row_group_size, options)

    def __call__(self, parts: Iterable[tuple[int, list[Piece]]]) -> Iterator[tuple[int, str]]:
        """(number of a part, its pieces in order) to (number, path)."""
        own, rows = f"{self.folder}/{uuid.uuid4().hex}", _Rows(self.schema)
        os.makedirs(own)
        for n, pieces in parts:
            path, held, size = f"{own}/{n}.parquet", [], 0
            with pq.ParquetWriter(path, self.schema, **self.options) as out:
                for piece in pieces:
                    for batch in rows.of(*piece):
                        held.append(batch)
                        size += batch.num_rows
                        if size >= self.rows_a_group:
                            table, whole = pa.Table.from_batches(held), size - size % self.rows_a_group
                            out.write_table(table.slice(0, whole), self.rows_a_group)
                            held, size = table.slice(whole).to_batches(), size - whole
                if size:
                    out.write_table(pa.Table.from_batches(held), self.rows_a_group)
            yield n, path


class _Rows:
    """Rows of files by their place. Two files stay open, since pieces of the sorted file go on where the last one ended, whatever parts are topped up between them."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.files: dict[str, _File] = {}  # the last one used last

    def of(self, path: str, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        file = self.files.pop(path, None)
        if file is None or lo < file.at:
            file = _File(path, lo, self.schema)
        while len(self.files) > 1:
            del self.files[next(iter(self.files))]
        self.files[path] = file
        return file.rows(lo, hi)


class _File:
    """A file that is read forwards, from the row group that has the first row asked for."""

    def __init__(self, path: str, lo: int, schema: pa.Schema):
        file = pq.ParquetFile(path, coerce_int96_timestamp_unit="us")
        there = {name.lower(): i for i, name in enumerate(file.schema_arrow.names)}
        self.schema, self.columns = schema, [there.get(f.name.lower()) for f in schema]
        group, self.at = 0, 0
        while group < file.num_row_groups and self.at + file.metadata.row_group(group).num_rows <= lo:
            self.at += file.metadata.row_group(group).num_rows
            group += 1
        self.batch: pa.RecordBatch | None = None
        self.rest = file.iter_batches(BATCH_ROWS, row_groups=range(group, file.num_row_groups), use_threads=False)

    def rows(self, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        while lo < hi:
            while self.batch is None or self.at + self.batch.num_rows <= lo:
                self.at += self.batch.num_rows if self.batch is not None else 0
                self.batch = self._typed(next(self.rest))
            upto = min(hi, self.at + self.batch.num_rows)
            yield self.batch.slice(lo - self.at, upto - lo)
            lo = upto

    def _typed(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """As declared; a column that the file hasn't is null, as in Spark's scans."""
        made = [pa.nulls(batch.num_rows, f.type) if i is None else batch.column(i).cast(f.type) for f, i in zip(self.schema, self.columns, strict=True)]
        return pa.RecordBatch.from_arrays(made, schema=self.schema)


def plan(held: Iterable[tuple[tuple, str, int, int]], tails: dict[tuple, tuple[int, str | None, int]], cap: int) -> list[tuple[tuple, int, list[Piece]]]:
    """Parts as (keys, file number, pieces).

    held: (keys, sorted file, first row, rows) in the order of the sort; tails: of each bucket the
    number of the first part to write, and the part that it tops up and its rows, which come first.
    """
    out: list[tuple[tuple, int, list[Piece]]] = []
    last: dict[tuple, tuple[int, int]] = {}  # of each bucket, its last part here and the rows in it
    for keys, path, at, n in held:
        if keys in last:
            part, rows = last[keys]
        else:
            number, tail, rows = tails[keys]
            part = len(out)
            out.append((keys, number, [(tail, 0, rows)] if tail else []))
        while n:
            if rows == cap:
                out.append((keys, out[part][1] + 1, []))
                part, rows = len(out) - 1, 0
            step = min(n, cap - rows)
            out[part][2].append((path, at, at + step))
            at, n, rows = at + step, n - step, rows + step
        last[keys] = part, rows
    return out
