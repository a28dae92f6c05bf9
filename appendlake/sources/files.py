"""Reading and writing csv, Arrow IPC and parquet files as DataFrames."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ipc

FORMATS = ("csv", "ipc", "parquet")
_SUFFIXES = {".csv": "csv", ".ipc": "ipc", ".arrow": "ipc", ".feather": "ipc", ".parquet": "parquet", ".pq": "parquet"}


def format_from_path(path: str | Path) -> str:
    """csv, ipc or parquet by the suffix; a URL's query doesn't count, and .tmp is looked through."""
    text = str(path)
    if text.startswith(("http://", "https://")):
        text = urlsplit(text).path
    name = Path(text)
    if name.suffix == ".tmp":
        name = name.with_suffix("")
    if name.suffix.lower() not in _SUFFIXES:
        raise ValueError(f"no format for {path}")
    return _SUFFIXES[name.suffix.lower()]


def scan_files(spark: SparkSession, paths: str | list[str], format: str | None = None, schema: T.StructType | None = None, base: str | None = None) -> DataFrame:
    """A lazy scan; of several paths the first gives the format. base: the folder below which Hive keys are parsed."""
    paths = [paths] if isinstance(paths, str | Path) else list(paths)
    paths = [str(p) for p in paths]
    format = format or format_from_path(paths[0])
    reader = spark.read.format("appendlake_ipc" if format == "ipc" else format)
    if format == "ipc":
        ipc.register(spark)
        return reader.option("paths", "\n".join(paths)).option("base", base or "").schema(schema or ipc.schema_of(spark, paths)).load()
    if schema is not None:
        reader = reader.schema(schema)
    if base is not None:
        reader = reader.option("basePath", base)
    if format == "csv":
        reader = reader.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option("emptyValue", "").option("nullValue", "\\N")
    with _few_listings(spark):
        return reader.load(paths)


@contextlib.contextmanager
def _few_listings(spark: SparkSession) -> Iterator[None]:
    """Spark lists each folder by a task of its own, of 10,000 at most; here a task lists many."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), 8 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parquet_options(schema, level: int | None, compression: str) -> dict[str, str]:
    """Writer options that follow from a schema: codec and level, exact rows a group, dictionaries by column."""
    out = {"compression": compression, "parquet.block.row.count.limit": str(schema.row_group_size)}
    if level is not None and compression == "zstd":
        out["parquet.compression.codec.zstd.level"] = str(level)
    for c in schema.columns:
        if c.kind != "nested":
            out[f"parquet.enable.dictionary#{c.name}"] = str(c.use_dictionary).lower()
    return out


def sink_files(df: DataFrame, path: str, format: str | None = None, mode: str = "errorifexists", partition_by: list[str] | None = None, **options: str) -> None:
    """Writes a folder of part files."""
    if partition_by and format is None:
        raise ValueError("a partitioned sink needs a format")
    format = format or format_from_path(path)
    if format == "ipc":
        ipc.register(df.sparkSession)
        if partition_by:
            raise ValueError("Arrow IPC files aren't partitioned by key here")
        df.write.format("appendlake_ipc").mode("append").option("path", path).option("compression", ipc.codec(options.get("compression")) or "").save()
        return
    writer = df.write.format(format).mode(mode).options(**options)
    if format == "csv":
        writer = writer.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option("emptyValue", "").option("nullValue", "\\N")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def row_len(spark: SparkSession, path: str, format: str | None = None) -> int:
    return scan_files(spark, path, format).count()


def row_lens(spark: SparkSession, paths: list[str], format: str, schema: T.StructType | None = None) -> dict[str, int]:
    """Rows of each file in one job, of parquet from the footers alone: no column is read."""
    if not paths:
        return {}
    if format == "ipc" or format == "parquet" and all(p.startswith("file:") for p in paths):
        return ipc.row_lens(spark, paths, format)
    found = scan_files(spark, paths, format, schema).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"))
    # Spark gives paths as URIs, in which what a folder's name escapes is escaped once more.
    plain = {_local(p): p for p in paths}
    out = dict.fromkeys(paths, 0)
    for path, n in found.toLocalIterator():
        out[plain[_local(unquote(path))]] = n
    return out


def _local(path: str) -> str:
    return path.replace("file:///", "/").replace("file:", "")


def data_root() -> str:
    """Where relative sources lie: APPENDLAKE_DATADIR, or a folder in the home."""
    return os.environ.get("APPENDLAKE_DATADIR") or str(Path.home() / ".appendlake")
