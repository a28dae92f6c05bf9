import datetime as dt
import decimal
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from appendlake import DictionaryPartition, MonoPartition, Table, TypeHints, WriterOptions
from appendlake import types as L
from appendlake.operators import parts
from appendlake.operators.commit import TableWriter
from appendlake.schema import Schema
from appendlake.sources.fs import Files


def names(t):
    return [f.partition(f"/{t.name}/")[2] for f in t.files()]


def test_plan_tops_up_and_rolls():
    held = [((1,), "a", 0, 5), ((2,), "a", 5, 4), ((2,), "b", 0, 3), ((3,), "b", 3, 1)]
    got = parts.plan(held, {(1,): (0, None, 0), (2,): (7, "t", 1), (3,): (2, None, 0)}, 3)
    assert got == [
        ((1,), 0, [("a", 0, 3)]), ((1,), 1, [("a", 3, 5)]), ((2,), 7, [("t", 0, 1), ("a", 5, 7)]), ((2,), 8, [("a", 7, 9), ("b", 0, 1)]), ((2,), 9, [("b", 1, 3)]), ((3,), 2, [("b", 3, 4)]),
    ]


def test_writer_copies_pieces_in_order(tmp_path):
    n = parts.BATCH_ROWS * 2 + 100
    for name, lo in (("a", 0), ("b", n)):
        pq.write_table(pa.table({"x": pa.array(range(lo, lo + n)), "s": pa.array([str(i) for i in range(lo, lo + n)])}), tmp_path / name, row_group_size=50_000)
    schema = Schema([("x", L.Int64), ("s", L.String), ("later", L.Float64)])
    made = parts.PartWriter.of(f"{tmp_path}/out", schema, schema.to_spark(), 3, "zstd", "4")
    made = parts.PartWriter(made.folder, made.schema, 60_000, made.options)
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    got = dict(made([(0, [(a, 10, 20)]), (1, [(a, 20, n), (b, 0, 5)]), (2, [(b, 70_000, 70_010), (a, 3, 4)])]))
    read = {i: pq.ParquetFile(p) for i, p in got.items()}
    assert [read[i].read().column("x").to_pylist() for i in (0, 1, 2)] == [list(range(10, 20)), list(range(20, n + 5)), [*range(n + 70_000, n + 70_010), 3]]
    meta = read[1].metadata
    assert [meta.row_group(g).num_rows for g in range(meta.num_row_groups)] == [60_000, 60_000, n + 5 - 20 - 120_000]
    assert meta.row_group(0).column(0).compression == "ZSTD" and read[0].read().column("later").null_count == 10


def test_a_sorted_file_is_read_once_whatever_is_topped_up(tmp_path, monkeypatch):
    """parts that are topped up are read between pieces of the sorted file, which isn't begun again for each."""
    pq.write_table(pa.table({"x": pa.array(range(100))}), tmp_path / "sorted")
    for i in range(20):
        pq.write_table(pa.table({"x": pa.array([1000 + i])}), tmp_path / f"t{i}")
    opened, file = [], parts.pq.ParquetFile
    monkeypatch.setattr(parts.pq, "ParquetFile", lambda path, **more: (opened.append(path), file(path, **more))[1])
    schema = Schema([("x", L.Int64)])
    made = parts.PartWriter.of(f"{tmp_path}/out", schema, schema.to_spark(), None, "snappy", "4")
    got = dict(made([(i, [(f"{tmp_path}/t{i}", 0, 1), (f"{tmp_path}/sorted", 5 * i, 5 * i + 5)]) for i in range(20)]))
    assert opened.count(f"{tmp_path}/sorted") == 1 and len(opened) == 21
    assert [pq.read_table(got[i]).column("x").to_pylist() for i in range(20)] == [[1000 + i, *range(5 * i, 5 * i + 5)] for i in range(20)]


def test_values_are_as_spark_stores_them(spark, tmp_path):
    columns = [("k", L.Mono(8)), ("i", L.Int8), ("d", L.Date), ("t", L.Datetime()), ("z", L.Datetime("us", "UTC")), ("b", L.Binary), ("m", L.Decimal(12, 2)), ("o", L.Boolean), ("f", L.Float32), ("s", L.String)]
    columns = [(n, k, TypeHints(optional=n != "k")) for n, k in columns]
    old, utc = dt.datetime(1500, 1, 2, 3, 4, 5, 6), dt.timezone.utc
    data = [(decimal.Decimal(2**64 - 1), -5, dt.date(1500, 1, 2), old, dt.datetime(1890, 1, 1, tzinfo=utc), b"\x00\xff", decimal.Decimal("-1.25"), True, 0.5, "é"), (decimal.Decimal(0), *[None] * 9)]
    t = Table(spark, "t", f"{tmp_path}/t", columns, partitioning=MonoPartition("k", 10**6))
    df = spark.createDataFrame(data, t.struct)
    t.append(df)
    assert sorted(map(tuple, t.scan().select(*t.schema.names).collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_old_rows_come_first_in_a_part_that_is_topped_up(spark, tmp_path, format):
    t = Table(spark, "t", f"{tmp_path}/t", [("x", L.Int64, TypeHints(sort="desc"))], format=format, writer_opts=WriterOptions(rows_per_file=4))
    for lo, hi in ((0, 3), (3, 9), (9, 10)):
        t.append(spark.range(lo, hi).withColumnRenamed("id", "x"))
    kept = [[r.x for r in spark.read.schema("x bigint").format(format).load(f).collect() if r.x is not None] for f in t.files()]
    assert kept == [[2, 1, 0, 8], [7, 6, 5, 4], [3, 9]]


def test_buckets_whose_names_are_not_ascii_keep_their_rows(spark, tmp_path):
    t = Table(spark, "t", f"{tmp_path}/t", [("k", L.Keyword), ("n", L.Int64)], partitioning=DictionaryPartition("k"))
    for i in range(3):
        t.append(spark.createDataFrame([("é", i)], "k string, n bigint"))
    assert sorted(r.n for r in t.scan().collect()) == [0, 1, 2]


def test_a_commit_asks_the_jvm_for_no_bucket(spark, tmp_path, monkeypatch):
    """calls of Hadoop's file system don't grow with the buckets, on a new table and on one that is topped up."""
    calls = []
    at = Files._at
    monkeypatch.setattr(Files, "_at", lambda self, path: (calls.append(path), at(self, path))[1])
    t = Table(spark, "t", f"{tmp_path}/t", [("x", L.Mono(4), TypeHints(sort="asc"))], partitioning=MonoPartition("x", 4))
    for lo in (0, 2):
        t.append(spark.range(800).where(f"id % 4 >= {lo} and id % 4 < {lo} + 2").withColumnRenamed("id", "x"))
        assert len(t.files()) == 200 and t.exists and t.disk_size > 0
    assert len(calls) < 100
    assert not [f for d, _, found in os.walk(f"{tmp_path}/t") for f in found if f.endswith(".crc")]
    assert t.scan().groupBy("bucket").count().where("count = 4").count() == 200


def test_equal_rows_are_split_among_tasks(spark, tmp_path, monkeypatch):
    """F5, F16: rows of one bucket without sort hints, or equal in them, are sorted by many tasks."""
    ranked = []
    remove = Files.remove

    def seen(self, path):
        if path.endswith("-ranked"):
            ranked.extend(pq.read_metadata(f"{path.removeprefix('file:')}/{f}").num_rows for f in os.listdir(path.removeprefix("file:")) if f.endswith(".parquet"))
        remove(self, path)

    monkeypatch.setattr(Files, "remove", seen)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name, hints in (("plain", []), ("hinted", [TypeHints(sort="asc")])):
            t = Table(spark, name, f"{tmp_path}/{name}", [("x", L.Int64, *hints)], writer_opts=WriterOptions(rows_per_file=700))
            t.append(spark.range(4000).selectExpr("cast(7 as bigint) as x"))
            assert max(ranked) < 2000 and sum(ranked) == 4000
            assert sorted(pq.read_metadata(f.removeprefix("file:")).num_rows for f in t.files()) == [500, *[700] * 5]
            ranked.clear()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_stopped_commit_of_many_moves_is_finished(spark, tmp_path):
    t = Table(spark, "t", f"{tmp_path}/t", [("x", L.Mono(4))], partitioning=MonoPartition("x", 10))
    t.append(spark.range(0, 1000, 2).withColumnRenamed("id", "x"))
    w = TableWriter(t)
    apply = w._apply
    w._apply = lambda moves, mark=None: (apply(moves[:50]), 1 / 0)
    with pytest.raises(ZeroDivisionError):
        w.stage_frame(spark.range(1, 1000, 2).withColumnRenamed("id", "x"))
    t.writer(break_lock=True).close()
    assert sorted(r.x for r in t.scan().collect()) == list(range(1000)) and len(t.files()) == 100


def test_ordered_commits_counts_rows_over_files(spark, monkeypatch):
    """a frame that begins in a later file than the first; rows were counted from its start."""
    from appendlake import queries as Q

    monkeypatch.setattr(Q, "WriterOptions", lambda **more: WriterOptions(**(more | {"rows_per_file": 400})))
    got = sorted(map(tuple, Q.ordered_commits(spark, "/root/testdata/sf0.001").select("frame", "first_row", "n").collect()))
    assert got == [(0, 0, 500), (1, 500, 500), (2, 1000, 500)]
