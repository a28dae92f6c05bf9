"""Commits: staged frames become numbered part files of at most rows_per_file rows, under a journal.

A commit is planned by rank, not by bucket, so that no bucket is bound to one task:

1. The new rows, and the rows of the last part of each touched bucket if that has
   room, are sorted by ranges of (keys, old before new, sort hints, arrival) and staged.
2. A row's rank in its bucket is its place in its range plus what earlier ranges
   hold of the bucket; file number = first number + rank // rows_per_file.
3. Rows are dealt by (keys, file number), so that each file is one task's, sorted,
   and written below .staging.
   Parquet on a shared disk needs no dealing and no old rows in the sort: there the
   driver cuts the staged files into parts, and tasks copy them (parts.py).
4. The moves are journalled, done and the journal deleted. A writer that opens the
   table replays a journal that is still there.

Readers between two moves can see a part of a commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LockedTableError
from ..sources.files import parquet_options, row_lens, scan_files, sink_files
from . import parts as direct

if TYPE_CHECKING:
    from ..table import Table

DEFAULT = "__HIVE_DEFAULT_PARTITION__"


def _plain(path: str) -> str:
    return path.replace("file:///", "/").replace("file:", "")


@dataclass(frozen=True)
class WriterOptions:
    """commit_threshold: staged rows that an ordered writer waits for; stage_threshold: rows of a builder's frame; start_frame_index: where an ordered writer begins."""

    stage_threshold: int = 500_000
    commit_threshold: int = 500_000
    rows_per_file: int = 500_000
    start_frame_index: int = 0

    def encode(self) -> dict[str, Any]:
        return asdict(self)


@dataclass(frozen=True)
class StagedPart:
    """A staged frame: a parquet folder of the declared columns and how many rows it has."""

    path: str
    rows: int
    index: int | None = None


def sort_columns(table: Table) -> list[Column]:
    """Order by the sort hints in schema order; nulls come first either way."""
    made = {"asc": lambda c: F.col(c).asc_nulls_first(), "desc": lambda c: F.col(c).desc_nulls_first()}
    return [made[c.hints.sort](f"`{c.name}`") for c in table.schema.columns if c.hints.sort]


class TableWriter:
    """The one writer of a table; a context manager that drains when all went well and keeps the table's lock meanwhile."""

    def __init__(self, table: Table, ordered: bool = False, break_lock: bool = False):
        if table.remote:
            raise ValueError(f"{table.name} is remote")
        self.table, self.files, self.spark = table, table.files_api, table.spark
        self.id, self.ordered = uuid.uuid4().hex, ordered
        self.staging = f"{table.path}/.staging/{self.id}"
        self.commits, self.next_index = 0, table.options.start_frame_index
        self.waiting: dict[int, StagedPart] = {}
        self.lock = f"{table.path}/.staging/.lock"
        if break_lock:
            self.files.remove(self.lock)
        if not self.files.create(self.lock, self.id, exclusive=True):
            raise LockedTableError(f"{table.path} has a writer already: {self.files.read(self.lock)}")
        self.recover()

    # -- staging

    def stage_frame(self, df: DataFrame, index: int | None = None, mark: tuple[str, str] | None = None) -> StagedPart:
        """Stages a frame of the declared columns and commits what can be. mark: a file and its text, written with the commit or not at all."""
        number = self.commits
        self.commits += 1
        path = f"{self.staging}/frame-{number}"
        df = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.table.struct.fields))
        df.write.parquet(path)
        stored = self.spark.read.schema(self.table.struct).parquet(path)
        part = StagedPart(path, stored.count(), index)
        if mark is not None and self.ordered:
            raise ValueError("a mark goes with a commit of its own, which an ordered writer's frames don't have")
        if mark is not None:
            self.integrate([part], mark)
        else:
            self.stage_part(part)
        return part

    def stage_part(self, part: StagedPart) -> None:
        """Commits a staged part at once, or, when ordered, as soon as all before it are there and enough rows wait."""
        if not self.ordered:
            self.integrate([part])
            return
        if part.index is None:
            raise ValueError("an ordered writer needs the index of a frame")
        if part.index in self.waiting or part.index < self.next_index:
            raise ValueError(f"frame {part.index} came before")
        self.waiting[part.index] = part
        self._release(self.table.options.commit_threshold)

    def _release(self, least: int) -> None:
        run, i = [], self.next_index
        while i in self.waiting:
            run.append(self.waiting[i])
            i += 1
        if run and sum(p.rows for p in run) >= least:
            self.integrate(run)
            for p in run:
                del self.waiting[p.index]
            self.next_index = i

    # -- integration

    def integrate(self, parts: Iterable[StagedPart], mark: tuple[str, str] | None = None) -> None:
        t, parts = self.table, [p for p in parts if p.rows]
        if not parts:
            if mark:
                self.files.create(*mark)
            return
        keys = list(t.key_types)
        frames = []
        for n, p in enumerate(parts):
            df = self.spark.read.schema(t.struct).parquet(p.path)
            # Arrival tells equal rows apart, so that ranges can split them.
            frames.append(t.with_keys(df, p.rows).withColumns({"__old": F.lit(1 + n), "__at": F.monotonically_increasing_id()}))
        new = frames[0]
        for f in frames[1:]:
            new = new.unionByName(f)
        commit = f"{self.staging}/commit-{self.commits}"
        self.commits += 1
        moves = self._write(new, keys, commit)
        journal = f"{self.staging}/journal-{self.commits}.json"
        self.files.create(journal, json.dumps({"moves": moves, "mark": mark}))
        self._apply(moves, mark)
        self.files.remove(journal)
        for path in (commit, f"{commit}-ranked", *(p.path for p in parts)):
            self.files.remove(path)
        t.forget()

    def _write(self, new: DataFrame, keys: list[str], commit: str) -> list[tuple[str, str, bool]]:
        """Writes the new files and gives their moves: (path, target, whether it tops up a part that is there)."""
        t, moves = self.table, None
        if self.files.local(t.path) and t.format == "parquet" and direct.fits(t.struct, t.compression):
            moves = self._cut(new, keys, commit)
        return self._deal(new, keys, commit) if moves is None else moves

    def _sorted(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Ranges of rows as they are to lie in a bucket: old before new, by the sort hints or by frame, then as they came."""
        hints = sort_columns(self.table)
        frame = F.col("__old") if self.ordered or not hints else F.least("__old", F.lit(1))
        order = [*(self._held_as(k).asc_nulls_first() for k in keys), frame, F.when(F.col("__old") == 0, F.col("__at")), *hints, F.col("__at")]
        return rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def _held_as(self, key: str) -> Column:
        """A key as its folder tells it: an empty text lies with the nulls."""
        return F.when(F.col(key) != "", F.col(key)) if self.table.key_types[key] == "string" else F.col(key)

    def _cut(self, new: DataFrame, keys: list[str], commit: str) -> list[tuple[str, str, bool]] | None:
        """Writes the new files from the sorted rows, as they lie; None for folders whose names the JVM may spell otherwise than Python."""
        t, ranked = self.table, f"{commit}-ranked"
        self._sorted(new, keys).drop("__at", "__old").write.parquet(ranked)
        files = {f.name: (f"{self.files.local(f.path)}", i) for i, f in enumerate(self.files.walk(ranked))}
        held = self.spark.read.schema(t.struct_with_keys).parquet(ranked).groupBy(F.col("_metadata.file_name").alias("__name"), *(self._held_as(k).alias(k) for k in keys)).agg(F.min("_metadata.row_index"), F.count("*")).collect()
        found = sorted((files[r[0]][1], r[-2], tuple(r[1:-2]), files[r[0]][0], r[-1]) for r in held)
        buckets = list(dict.fromkeys(f[2] for f in found))
        folders = {b: self._folder(keys, b) for b in buckets}
        if not all(f.isascii() for f in folders.values()):
            self.files.remove(ranked)
            return None
        last = self._last(buckets)
        cut = direct.plan(((b, path, at, n) for _, at, b, path, n in found), {b: (i, self.files.local(p) if p else None, n) for b, (i, p, n) in last.items()}, t.options.rows_per_file)
        made = direct.PartWriter.of(self.files.local(commit), t.schema, t.struct, t.compression_level, t.compression, self.spark.version)
        sc, work = self.spark.sparkContext, [(n, pieces) for n, (_, _, pieces) in enumerate(cut)]
        written = sc.parallelize(work, min(len(work), 4 * sc.defaultParallelism)).mapPartitions(made).collect()
        if sorted(n for n, _ in written) != list(range(len(cut))):
            raise RuntimeError(f"{len(written)} of {len(cut)} parts are there")
        topped, moves = {(b, i) for b, (i, p, _) in last.items() if p}, []
        for n, path in written:
            b, i, _ = cut[n]
            moves.append((f"file:{path}", "/".join(filter(None, [t.path, folders[b], t.part_file(i)])), (b, i) in topped))
        return moves

    def _deal(self, new: DataFrame, keys: list[str], commit: str) -> list[tuple[str, str, bool]]:
        """Writes the new files by Spark's writers, one task for each file."""
        t = self.table
        last = self._last([tuple(r) for r in new.select(*keys).distinct().collect()] if keys else [()])
        firsts, tails = [(*b, i) for b, (i, _, _) in last.items()], [p for _, p, _ in last.values() if p]
        rows = new
        if tails:
            old = scan_files(self.spark, tails, t.format, t.struct_with_keys, base=t.path) if t.format != "csv" else self._csv_tails(tails)
            rows = new.unionByName(old.select(*t.struct.fieldNames(), *keys).withColumns({"__old": F.lit(0), "__at": F.monotonically_increasing_id()}))
        ranked = f"{commit}-ranked"
        self._sorted(rows, keys).withColumn("__id", F.monotonically_increasing_id()).drop("__at").write.parquet(ranked)
        stored = self.spark.read.schema(T.StructType([*t.struct_with_keys.fields, T.StructField("__old", T.IntegerType()), T.StructField("__id", T.LongType())])).parquet(ranked)
        stored = stored.withColumn("__part", F.shiftright("__id", 33).cast("int"))
        # What earlier ranges hold of each bucket: a row for each (range, bucket) that meet.
        held = stored.groupBy("__part", *keys).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
        w = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        held = held.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
        start = self.spark.createDataFrame(firsts, T.StructType([*(T.StructField(k, self._key_type(k)) for k in keys), T.StructField("__start", T.LongType())]))
        held = self._same(held, start, keys)
        ranked_rows = self._same(stored, held, ["__part", *keys])
        cap = t.options.rows_per_file
        numbered = ranked_rows.withColumn("__file", F.expr(f"__start + (__before + __id - __first) div {cap}L"))
        # One task for each file; equal (keys, file) come together.
        dealt = numbered.repartition(*keys, "__file").sortWithinPartitions(*(F.col(k).asc_nulls_first() for k in keys), "__file", "__id")
        return self._sink(dealt, keys, commit, tails)

    def _key_type(self, key: str) -> T.DataType:
        return {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}[self.table.key_types[key]]

    @staticmethod
    def _same(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """A join on keys that may be null."""
        if not on:
            return left.join(F.broadcast(right))  # the one bucket of an unpartitioned table
        named = right.withColumnsRenamed({k: f"__r_{k}" for k in on})
        cond = None
        for k in on:
            one = left[k].eqNullSafe(named[f"__r_{k}"])
            cond = one if cond is None else cond & one
        return left.join(named, cond).drop(*(f"__r_{k}" for k in on))

    def _last(self, buckets: list[tuple]) -> dict[tuple, tuple[int, str | None, int]]:
        """Of each bucket the number of the first file to write, and the last part and its rows if that has room."""
        t = self.table
        if not t.exists:
            return dict.fromkeys(buckets, (0, None, 0))

        def last_part(b: Any) -> tuple[int, str | None]:
            there = self.files.children(f"{t.path}/{self._folder(list(t.key_types), b)}".rstrip("/"))
            found = [(i, p) for p in there if (i := t.part_index(p.rpartition("/")[2])) is not None]
            return max(found, default=(-1, None))

        # The touched buckets' folders only.
        last = dict(zip(buckets, map(last_part, buckets) if self.files.local(t.path) else self.files.each(last_part, buckets), strict=True))
        lens = row_lens(self.spark, [p for _, p in last.values() if p], t.format, t.struct)
        return {b: (i, p, lens[p]) if p is not None and lens[p] < t.options.rows_per_file else (i + 1, None, 0) for b, (i, p) in last.items()}

    def _csv_tails(self, paths: list[str]) -> DataFrame:
        df = scan_files(self.spark, paths, "csv", self.table.struct)
        return self.table.with_keys(df, None, stored=True)

    @staticmethod
    def _folder(keys: list[str], values: Any) -> str:
        """Hive folders as Spark names them."""
        escape = lambda v: "".join(f"%{ord(c):02X}" if 0 < ord(c) < 32 or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in str(v))
        return "/".join(f"{k}={DEFAULT if v is None or v == '' else escape(v)}" for k, v in zip(keys, values, strict=True))

    def _sink(self, dealt: DataFrame, keys: list[str], commit: str, tails: list[str]) -> list[tuple[str, str, bool]]:
        """Writes the new files and gives their moves; what is there already under a new file's name is a tail that it tops up."""
        t, moves = self.table, []
        if t.format == "ipc":
            folder = F.concat_ws("/", *(F.concat(F.lit(f"{k}="), F.when(F.col(k).cast("string").isNull() | (F.col(k).cast("string") == ""), DEFAULT).otherwise(F.col(k).cast("string"))) for k in keys), F.format_string("%05d", "__file"))
            sink_files(dealt.select(*t.struct.fieldNames(), folder.alias("__file")), commit, "ipc", compression=t.compression)
            for e in self.files.walk(commit):
                inside = e.path.split(f"/{commit.rpartition('/')[2]}/", 1)[1]
                bucket, _, name = inside.rpartition("/")
                moves.append((e.path, "/".join(filter(None, [t.path, bucket, t.part_file(int(name))]))))
        else:
            options = parquet_options(t.schema, t.compression_level, t.compression) if t.format == "parquet" else {}
            sink_files(dealt.select(*t.struct.fieldNames(), *keys, "__file"), commit, t.format, partition_by=[*keys, "__file"], **options)
            for path in self.files.glob(f"{commit}/{'*/' * (len(keys) + 1)}[!._]*"):
                folders = path.split(f"/{commit.rpartition('/')[2]}/", 1)[1].split("/")[:-1]
                number = int(folders[-1].removeprefix("__file="))
                moves.append((path, "/".join([t.path, *folders[:-1], t.part_file(number)])))
        seen: set[str] = set()
        for _, dst in moves:
            if dst in seen:
                raise RuntimeError(f"two parts for {dst}")
            seen.add(dst)
        plain = {_plain(p) for p in tails}
        return [(src, dst, _plain(dst) in plain) for src, dst in moves]

    def _apply(self, moves: list[tuple[str, str, bool]], mark: tuple[str, str] | None = None) -> None:
        self.files.move_all(moves)
        if mark:
            self.files.create(*mark)

    def recover(self) -> None:
        """Finishes journalled commits of writers that are gone, and removes what they staged only."""
        for other in self.files.list(f"{self.table.path}/.staging"):
            if not other.is_dir or other.name == self.id:
                continue
            for e in self.files.list(other.path):
                if e.name.startswith("journal-"):
                    done = json.loads(self.files.read(e.path))
                    self._apply([tuple(m) for m in done["moves"]], done["mark"])
            self.files.remove(other.path)
        self.table.forget()

    def drain(self) -> None:
        """Commits what still waits, in order, and removes this writer's staging."""
        if self.ordered and self.waiting:
            self._release(0)
            if self.waiting:
                raise RuntimeError(f"frame {self.next_index} never came; {sorted(self.waiting)} wait for it")
        self.files.remove(self.staging)

    def close(self, abort: bool = False) -> None:
        try:
            if not abort:
                self.drain()
            else:
                self.files.remove(self.staging)
        finally:
            self.files.remove(self.lock)

    def __enter__(self) -> TableWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        self.close(abort=kind is not None)
