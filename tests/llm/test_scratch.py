"""Scratch tables: read back whole, without a marker that the driver would have to write."""

from __future__ import annotations

from pathlib import Path

from appendlake.llm import _common as C


def test_scratch_has_no_marker(spark):
    scratch = C.Scratch(spark, "marker")
    kept = scratch.save(spark.range(1000).repartition(3), "t")
    folder = Path(scratch.root.removeprefix("file://").removeprefix("file:")) / "t"
    assert sorted(r.id for r in kept.collect()) == list(range(1000))
    assert list(folder.glob("*.parquet")) and not (folder / "_SUCCESS").exists()
    assert scratch.save(spark.range(0), "empty").count() == 0


def _resident(pid) -> int:
    """MB of a process, without files."""
    return int(next(x for x in Path(f"/proc/{pid}/smaps_rollup").read_text().splitlines() if x.startswith("Anonymous")).split()[1]) >> 10


def test_freed_memory_goes_back(spark):
    """100 MB are allocated beside the JVM's heap in small blocks and all but each 16th freed; malloc alone keeps them."""
    scratch, jvm = C.Scratch(spark, "back"), spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    scratch.settle()
    blocks = [jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(1600)]
    full = _resident(pid)
    blocks = blocks[::16]
    scratch.settle()  # collects the rest
    scratch.settle()  # cleaners run beside the first
    assert len(blocks) == 100 and full - _resident(pid) > 50
