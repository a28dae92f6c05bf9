"""Arrow IPC files as a Spark data source; each file is read by one task, record batch by record batch.

Files are opened by pyarrow's own file systems (local or shared folders, HDFS, S3),
since executors have no Hadoop client in Python. A write goes to temporary names,
which only the commit makes final.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def _files(paths: list[str]) -> list[str]:
    out = []
    for path in paths:
        fs, at = _open(path)
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.Directory:
            found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
            inside = [f.path for f in found if f.type == pafs.FileType.File and not any(p.startswith((".", "_")) for p in f.path[len(at) :].strip("/").split("/"))]
            prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
            out += [prefix + p for p in sorted(inside)]
        elif info.type == pafs.FileType.File:
            out.append(path)
        else:
            raise FileNotFoundError(path)
    return out


def codec(compression: str | None) -> str | None:
    """lz4, zstd or None, the codecs of IPC files; 'uncompressed' is None, and so is a codec that they lack."""
    return compression if compression in ("lz4", "zstd") else None


def _rows(path: str, format: str) -> int:
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        if format == "parquet":
            return pq.read_metadata(f).num_rows
        with pa.ipc.open_file(f) as reader:
            return sum(reader.get_batch(i).num_rows for i in range(reader.num_record_batches))


def row_lens(spark: SparkSession, paths: list[str], format: str = "ipc") -> dict[str, int]:
    """Rows of each file by pyarrow, in one job over the files."""
    parts = min(len(paths), 4 * spark.sparkContext.defaultParallelism)
    return dict(spark.sparkContext.parallelize(paths, parts).map(lambda p: (p, _rows(p, format))).collect())


def schema_of(spark: SparkSession, paths: list[str]) -> T.StructType:
    fs, at = _open(_files(paths)[0])
    with fs.open_input_file(at) as f:
        return from_arrow_schema(pa.ipc.open_file(f).schema)


@dataclass
class _File(InputPartition):
    path: str


class IpcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, paths: list[str], base: str):
        self.schema, self.paths, self.base = schema, paths, base

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _files(self.paths)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        want = to_arrow_schema(self.schema)
        fs, at = _open(partition.path)
        keys = dict(p.split("=", 1) for p in at.split("/") if "=" in p)
        with fs.open_input_file(at) as f, pa.ipc.open_file(f) as reader:
            for i in range(reader.num_record_batches):
                batch = reader.get_batch(i)
                cols = []
                for field in want:
                    if field.name in batch.schema.names:
                        cols.append(batch.column(field.name).cast(field.type))
                    else:
                        value = keys.get(field.name)
                        value = None if value in (None, "__HIVE_DEFAULT_PARTITION__") else unquote(value)
                        cols.append(pc.cast(pa.array([value] * batch.num_rows, pa.string()), field.type))
                yield pa.RecordBatch.from_arrays(cols, schema=want)


@dataclass
class _Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class IpcWriter(DataSourceArrowWriter):
    """With a column __file, rows go to that file below the path (rows of a file come together), else to a file for each task."""

    def __init__(self, path: str, compression: str | None = None):
        self.path, self.compression = path.rstrip("/"), compression

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        moves, sink, current = [], None, None
        fs, root = _open(self.path)

        def close() -> None:
            if sink is not None:
                sink[0].close()
                sink[1].close()

        for batch in iterator:
            named = "__file" in batch.schema.names
            names = batch.column("__file").to_pylist() if named else [None] * batch.num_rows
            rest = batch.drop_columns(["__file"]) if named else batch
            lo = 0
            while lo < len(names):
                hi = lo + 1
                while hi < len(names) and names[hi] == names[lo]:
                    hi += 1
                if sink is None or names[lo] != current:
                    close()
                    current = names[lo]
                    final = f"{root}/{current or f'part-{uuid.uuid4().hex}.ipc'}"
                    folder, _, base = final.rpartition("/")
                    fs.create_dir(folder, recursive=True)
                    temp = f"{folder}/.{base}.{uuid.uuid4().hex}.tmp"
                    out = fs.open_output_stream(temp)
                    sink = (pa.ipc.new_file(out, rest.schema, options=pa.ipc.IpcWriteOptions(compression=self.compression)), out)
                    moves.append((temp, final))
                sink[0].write_batch(rest.slice(lo, hi - lo))
                lo = hi
        close()
        return _Written(moves)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            for temp, final in m.moves if m else []:
                fs.move(temp, final)

    def abort(self, messages: list[_Written | None]) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            for temp, _final in m.moves if m else []:
                fs.delete_file(temp)


class IpcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "appendlake_ipc"

    def schema(self) -> str:
        raise ValueError("an IPC scan needs a schema")

    def reader(self, schema: T.StructType) -> IpcReader:
        return IpcReader(schema, self.options["paths"].split("\n"), self.options.get("base", ""))

    def writer(self, schema: T.StructType, overwrite: bool) -> IpcWriter:
        return IpcWriter(self.options["path"], self.options.get("compression") or None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IpcSource)
