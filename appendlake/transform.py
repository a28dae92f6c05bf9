"""Transforms: derived tables that are materialised once and then scanned."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession

from .sources.files import scan_files, sink_files
from .sources.fs import Files

if TYPE_CHECKING:
    from .context import Context


class Transform:
    """query: a DataFrame or a function of the context. The cache is written beside and moved into place."""

    def __init__(
        self,
        spark: SparkSession,
        name: str,
        query: DataFrame | Callable[[Context], DataFrame],
        cache_path: str,
        cache_format: str = "parquet",
        sink_args: dict[str, Any] | None = None,
        *,
        partition_by: list[str] | None = None,
        include_key: bool = False,
        per_partition_sort_by: list[str] | None = None,
        prepare: Callable[[DataFrame], DataFrame] | None = None,
    ):
        if partition_by and cache_format != "parquet":
            raise ValueError("a partitioned cache is parquet")
        self.spark, self.name, self.query, self.path, self.format = spark, name, query, str(cache_path).rstrip("/"), cache_format
        self.sink_args, self.partition_by, self.include_key = sink_args or {}, partition_by or [], include_key
        self.sort_by, self.prepare, self.files = per_partition_sort_by or [], prepare, Files(spark)
        self._frame: DataFrame | None = None

    @property
    def is_cached(self) -> bool:
        return self.files.exists(self.path)

    @property
    def disk_size(self) -> int:
        return sum(e.size for e in self.files.walk(self.path))

    def clear_cache(self) -> None:
        self.files.remove(self.path)
        self._frame = None

    def scan(self, ctx: Context | None = None, use_cache: bool = True) -> DataFrame:
        """The cached rows, after computing them if need be. use_cache=False passes the remembered frame by, not the files."""
        if use_cache and self._frame is not None:
            return self._frame
        if not self.is_cached:
            self._fill(ctx)
        self._frame = scan_files(self.spark, self.path, self.format, self._struct)
        if self.partition_by and self.include_key:
            self._frame = self._frame.drop(*self.partition_by).withColumnsRenamed({f"__key_{k}": k for k in self.partition_by})
        return self._frame

    _struct = None

    def _fill(self, ctx: Context | None) -> None:
        df = self.query
        if callable(df) and not isinstance(df, DataFrame):
            if ctx is None:
                raise FileNotFoundError(f"{self.name} isn't cached, and its query needs a context")
            df = df(ctx)
        if self.prepare:
            df = self.prepare(df)
        temp = f"{self.path}.tmp"
        self.files.remove(temp)
        if self.partition_by:
            if self.include_key:
                df = df.withColumns({f"__key_{k}": df[k] for k in self.partition_by})
            df = df.repartition(*self.partition_by).sortWithinPartitions(*self.partition_by, *self.sort_by)
        sink_files(df, temp, self.format, partition_by=self.partition_by, **self.sink_args)
        self.files.move(temp, self.path, replace=True)
