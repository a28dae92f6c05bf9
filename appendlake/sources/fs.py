"""Files through Hadoop's FileSystem, so that local, HDFS and object-store paths work alike. Names and sizes only, no data.

Those of the driver's own disk are listed and moved by the os module: a call of the JVM takes a
millisecond or more and starts commands there, which counts where a commit has a file for each of many buckets.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

PARALLEL = 16  # listings and renames at a time


@dataclass(frozen=True)
class Entry:
    path: str
    size: int
    is_dir: bool

    @property
    def name(self) -> str:
        return self.path.rstrip("/").rpartition("/")[2]


def _is_sum(name: str) -> bool:
    """A checksum file, which Hadoop's local file system keeps beside a file and hides."""
    return name.startswith(".") and name.endswith(".crc")


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self._systems = spark, {}
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._own_default = (spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///").startswith("file:")

    def local(self, path: str) -> str | None:
        """The path on the driver's own disk; None elsewhere, and for names that the JVM's locale may spell otherwise."""
        at = "/" + path[5:].lstrip("/") if path.startswith("file:") else path if self._own_default else ""
        return (at.rstrip("/") or "/") if at.startswith("/") and at.isascii() else None

    def _at(self, path: str):
        jpath, root = self._path(path), path.split("://", 1)[0] + path.split("://", 1)[-1].split("/", 1)[0] if "://" in path else ""
        if root not in self._systems:
            self._systems[root] = jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self._systems[root], jpath

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[Entry]:
        """Children, by name; none of a missing folder."""
        at = self.local(path)
        if at is not None and (os.path.isdir(at) or not os.path.lexists(at)):
            with contextlib.suppress(FileNotFoundError), os.scandir(at) as there:
                found = [Entry(f"file:{e.path}", 0 if e.is_dir() else e.stat().st_size, e.is_dir()) for e in there if not _is_sum(e.name)]
                if all(e.path.isascii() for e in found):
                    return sorted(found, key=lambda e: e.path)
            if not os.path.lexists(at):
                return []
        fs, p = self._at(path)
        try:
            statuses = fs.listStatus(p)
        except Exception:
            if not fs.exists(p):
                return []
            raise
        found = [Entry(s.getPath().toString(), s.getLen(), s.isDirectory()) for s in statuses]
        return sorted(found, key=lambda e: e.path)

    def _paths(self, statuses) -> list[str]:
        """Paths of many files in one answer of the JVM."""
        jvm = self.spark._jvm
        text = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(statuses)).mkString("\n")
        return text.split("\n") if text else []

    def children(self, path: str) -> list[str]:
        """Paths of what lies in a folder; none of a missing one."""
        if self.local(path) is not None:
            return [e.path for e in self.list(path)]
        fs, p = self._at(path)
        try:
            return self._paths(fs.listStatus(p))
        except Exception:
            if not fs.exists(p):
                return []
            raise

    def glob(self, pattern: str) -> list[str]:
        fs, p = self._at(pattern)
        found = fs.globStatus(p)
        return self._paths(found) if found is not None else []

    def move_all(self, moves: list[tuple[str, str, bool]]) -> None:
        """(source, target, whether the target is there and is replaced) each; sources that are gone were moved before."""
        own, far = [], []
        for m in moves:
            a, b = self.local(m[0]), self.local(m[1])
            (far if a is None or b is None else own).append(m if a is None or b is None else (a, b))
        for folder in sorted({b.rpartition("/")[0] for _, b in own}):
            os.makedirs(folder, exist_ok=True)
        for a, b in own:
            if os.path.lexists(a):
                folder, _, name = b.rpartition("/")
                with contextlib.suppress(FileNotFoundError):
                    os.remove(f"{folder}/.{name}.crc")  # of what lay there
                os.replace(a, b)
        if not far:
            return
        self.each(self.make, sorted({dst.rpartition("/")[0] for _, dst, _ in far}))

        def one(move: tuple[str, str, bool]) -> None:
            (fs, a), (_, b) = self._at(move[0]), self._at(move[1])
            if move[2]:
                if not fs.exists(a):
                    return
                fs.delete(b, True)
            try:
                done = fs.rename(a, b)
            except Exception:
                if fs.exists(a):
                    raise
                return
            if not done and fs.exists(a):
                raise OSError(f"{move[0]} can't be moved to {move[1]}")

        self.each(one, far)

    def walk(self, path: str) -> list[Entry]:
        """Files below, without what lies in hidden folders or is hidden itself."""
        out = []
        for e in self.list(path):
            if e.name.startswith((".", "_")):
                continue
            out += self.walk(e.path) if e.is_dir else [e]
        return out

    def first(self, path: str, suffix: str) -> str | None:
        """A file below whose name ends so, found without listing more folders than it takes."""
        for e in self.list(path):
            if e.name.startswith((".", "_")):
                continue
            found = self.first(e.path, suffix) if e.is_dir else e.path if e.name.endswith(suffix) else None
            if found:
                return found
        return None

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def move(self, src: str, dst: str, replace: bool = False) -> None:
        fs, a = self._at(src)
        _, b = self._at(dst)
        if replace:
            fs.delete(b, True)
        fs.mkdirs(b.getParent())
        if not fs.rename(a, b):
            raise OSError(f"{src} can't be moved to {dst}")

    def each(self, do: Callable[[Any], Any], items: Iterable[Any]) -> list[Any]:
        """do(item) for all of them, as many at once as a name node likes; the first error is raised."""
        with ThreadPoolExecutor(PARALLEL) as pool:
            return list(pool.map(do, items))

    def create(self, path: str, text: str, exclusive: bool = False) -> bool:
        """Writes a file whole; with exclusive, False if it is there already."""
        at = self.local(path)
        if at is not None and not exclusive:
            folder, _, name = at.rpartition("/")
            os.makedirs(folder, exist_ok=True)
            with open(f"{folder}/.{name}.tmp", "w", encoding="utf-8") as out:
                out.write(text)
            self.move_all([(f"file:{folder}/.{name}.tmp", f"file:{at}", True)])
            return True
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        try:
            out = fs.create(p, not exclusive)
        except Exception as e:
            if exclusive and fs.exists(p):
                return False
            raise e
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, path: str) -> str:
        at = self.local(path)
        if at is not None:
            with open(at, encoding="utf-8") as f:
                return f.read()
        fs, p = self._at(path)
        source = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()
