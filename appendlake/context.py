"""Contexts: a catalog of tables and transforms, with builders and writers over all of its tables."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .operators.builder import TableBuilder
from .operators.commit import StagedPart, TableWriter
from .table import Table
from .transform import Transform

log = logging.getLogger("appendlake")


def utc_logging(level: int = logging.INFO) -> None:
    """ISO-8601 times in UTC on the library's own logger."""
    handler = logging.StreamHandler()
    form = logging.Formatter("%(asctime)sZ %(levelname)s %(message)s", "%Y-%m-%dT%H:%M:%S")
    form.converter = time.gmtime
    handler.setFormatter(form)
    log.handlers[:] = [handler]
    log.setLevel(level)


class Context:
    """Tables and transforms by name, as attributes and as items; of equal names the table counts."""

    def __init__(self, spark: SparkSession, tables: Iterable[Table], transforms: Iterable[Transform] = (), datadir: str | None = None):
        self.spark = spark
        self.tables = {t.name: t.copy(datadir=datadir) if datadir else t for t in tables}
        self.transforms = {t.name: t for t in transforms}

    def __getitem__(self, name: str) -> Table | Transform:
        if name in self.tables:
            return self.tables[name]
        return self.transforms[name]

    def __getattr__(self, name: str) -> Table | Transform:
        if not name.startswith("_") and name not in ("tables", "transforms"):
            for kind in (self.tables, self.transforms):
                if name in kind:
                    return kind[name]
        raise AttributeError(name)

    def __contains__(self, name: object) -> bool:
        return name in self.tables or name in self.transforms

    def __dir__(self) -> list[str]:
        return sorted({*super().__dir__(), *self.tables, *self.transforms})

    def register_views(self) -> None:
        """Temporary views of all that can be scanned, for SQL."""
        for t in self.transforms.values():
            t.scan(self).createOrReplaceTempView(t.name)
        for t in self.tables.values():
            t.scan().createOrReplaceTempView(t.name)

    def ensure_cache(self, regen: bool = False, skip_remotes: bool = False) -> dict[str, int]:
        """Scans every table and transform once; what fails is logged and left out. regen computes transforms anew. Gives rows by name."""
        out = {}
        for t in [*self.tables.values(), *self.transforms.values()]:
            if skip_remotes and isinstance(t, Table) and t.remote:
                continue
            began = time.monotonic()
            try:
                if isinstance(t, Transform) and regen:
                    t.clear_cache()
                rows = (t.scan() if isinstance(t, Table) else t.scan(self)).count()
            except Exception as e:  # noqa: BLE001  one failure doesn't keep the others from being cached
                log.warning("%s: %s", t.name, e)
                continue
            out[t.name] = rows
            log.info("%s: %s rows, %s bytes, %.1f s", t.name, f"{rows:,}", f"{t.disk_size:,}", time.monotonic() - began)
        return out

    def builder(self, scope: str = "session") -> ContextBuilder:
        return ContextBuilder(self, scope)

    def writer(self, ordered: bool = False) -> ContextWriter:
        return ContextWriter(self, ordered)


class ContextBuilder:
    """A builder for each local table."""

    def __init__(self, ctx: Context, scope: str = "session"):
        self.builders = {n: TableBuilder(t, scope) for n, t in ctx.tables.items() if not t.remote}

    def append(self, name: str, row: Any) -> bool:
        return self.builders[name].append(row)

    def extend(self, name: str, rows: Iterable) -> int:
        return self.builders[name].extend(rows)

    def push(self, rows: dict[str, Iterable]) -> None:
        for name, some in rows.items():
            self.extend(name, some)

    def flush(self) -> dict[str, DataFrame]:
        """All rows, by table."""
        return {n: df for n, b in self.builders.items() if (df := b.flush()) is not None}

    def frames(self, drain: bool = False) -> dict[str, list[DataFrame]]:
        """Frames of exactly stage_threshold rows; with drain, one of the rest as well."""
        out: dict[str, list[DataFrame]] = {}
        for name, b in self.builders.items():
            size = b.table.options.stage_threshold
            while b.rows() >= size or (drain and b.rows()):
                out.setdefault(name, []).append(b.flush(size, drain=drain))
        return out


class ContextWriter:
    """A writer for each local table, opened when it is first needed; a context manager, which aborts on an exception."""

    def __init__(self, ctx: Context, ordered: bool = False):
        self.ctx, self.ordered, self.writers = ctx, ordered, {}

    def _of(self, name: str) -> TableWriter:
        if name not in self.ctx.tables:
            raise RuntimeError(f"no table {name}")
        if name not in self.writers:
            self.writers[name] = self.ctx.tables[name].writer(self.ordered)
        return self.writers[name]

    def stage_part(self, name: str, part: StagedPart) -> None:
        self._of(name).stage_part(part)

    def stage_frame(self, name: str, df: DataFrame, index: int | None = None) -> StagedPart:
        return self._of(name).stage_frame(df, index)

    def stage_all(self, frames: dict[str, list[DataFrame]]) -> None:
        for name, some in frames.items():
            for df in some:
                w = self._of(name)
                w.stage_frame(df, w.next_index + len(w.waiting) if self.ordered else None)

    def close(self, abort: bool = False) -> None:
        errors = []
        for w in self.writers.values():
            try:
                w.close(abort)
            except Exception as e:  # noqa: BLE001  the others are closed first
                errors.append(e)
        self.writers = {}
        if errors:
            raise errors[0]

    def __enter__(self) -> ContextWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        self.close(abort=kind is not None)
