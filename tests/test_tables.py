import datetime as dt
import io
import threading
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, HTTPServer

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from appendlake import Context, ContextBuilder, DictionaryPartition, MonoPartition, Table, TableBuilder, TimePartition, Transform, TypeHints, WriterOptions
from appendlake import types as L
from appendlake.errors import LockedTableError, TableLayoutError
from appendlake.operators.dedupe import anti_existing, greedy_unique, keep_first
from appendlake.sources import remote
from appendlake.sources.files import format_from_path, row_len, row_lens, scan_files, sink_files
from appendlake.streaming import TableSink

EVENTS = [("eid", L.Mono(4), TypeHints(sort="asc")), ("payload", L.String, TypeHints(avg_str_size=16, optional=True))]


def make(spark, tmp_path, columns=EVENTS, by=MonoPartition("eid", 3), name="events", **more):
    return Table(spark, name, name, columns, datadir=str(tmp_path), partitioning=by, **more)


def rows(t):
    return sorted(map(tuple, t.scan().select(*t.schema.names).collect()))


def ids(spark, values):
    return spark.createDataFrame([(v, f"p{v}") for v in values], "eid bigint, payload string")


@pytest.mark.parametrize("format", ["parquet", "csv", "ipc"])
def test_round_trip_and_roll(spark, tmp_path, format):
    t = make(spark, tmp_path, format=format, writer_opts=WriterOptions(rows_per_file=2))
    assert not t.exists and t.scan().count() == 0 and t.disk_size == 0
    t.append(ids(spark, [0, 5, 2, 3, 8, 1, 6]))
    assert rows(t) == [(i, f"p{i}") for i in (0, 1, 2, 3, 5, 6, 8)]
    names = [f.partition("/events/")[2] for f in t.files()]
    assert names == [f"bucket={b}/0000{i}.{format}" for b, i in ((0, 0), (0, 1), (1, 0), (2, 0))]
    t.append(ids(spark, [4, 7]))  # bucket 1 and 2 top up to a new part
    assert rows(t) == [(i, f"p{i}") for i in range(9)]
    counts = {f.partition("/events/")[2]: row_len(spark, f, format) for f in t.files()}
    assert set(counts.values()) <= {1, 2} and len(counts) == 6
    assert not t.files_api.list(f"{t.path}/.staging")
    assert t.disk_size > 0 and sum(row_lens(spark, t.files(), format, t.struct).values()) == 9


def test_nulls_empty_and_odd_keys(spark, tmp_path):
    t = make(spark, tmp_path, [("k", L.Keyword, TypeHints(optional=True)), ("n", L.Int64)], DictionaryPartition("k"))
    t.append(spark.createDataFrame([("/a", 1), ("", 2), (None, 3), ("%b", 4), ("=", 5), ("é", 6), (" x", 7)], "k string, n bigint"))
    t.append(spark.createDataFrame([("/c", 8), ("", 9), (None, 10), ("%", 11)], "k string, n bigint"))
    assert sorted(r.n for r in t.scan().collect()) == list(range(1, 12))
    assert [r.n for r in t.lookup("k", "").orderBy("n").collect()] == [2, 9]
    assert [r.n for r in t.lookup("k", "/a").collect()] == [1]
    exact = {r.n: r.char0 for r in t.scan(exact_keys=True).collect()}
    assert exact[2] == "" and exact[3] is None and exact[8] == "/"
    assert all(f.endswith("00000.parquet") for f in t.files())  # small buckets keep one part


def test_prefix_and_metadata(spark, tmp_path):
    t = make(spark, tmp_path, by=None, prefix="part", writer_opts=WriterOptions(rows_per_file=4))
    t.append(ids(spark, range(6)))
    assert [f.rpartition("/")[2] for f in t.files()] == ["part-00000.parquet", "part-00001.parquet"] and t.file_pattern == "part-*.parquet"
    assert Table.decode(spark, t.to_json(), datadir=str(tmp_path)) == t and t.copy(prefix=None).part_file(3) == "00003.parquet"
    assert t.copy(writer_opts=WriterOptions(rows_per_file=9)).options.rows_per_file == 9
    assert "eid" in t.pretty_str() and t.row_class()(eid=1).payload is None
    assert t.compression_level == 6 and t.copy(schema=[("s", L.String)]).compression_level == 10 and t.copy(compression="uncompressed").compression_level is None
    meta = pq.ParquetFile(t.files()[0].removeprefix("file:"))
    assert meta.metadata.row_group(0).column(0).compression == "ZSTD" and meta.schema_arrow.names == ["eid", "payload"]


def test_pruned_lookup(spark, tmp_path):
    t = make(spark, tmp_path)
    t.append(ids(spark, range(9)))
    for df, want in ((t.lookup("eid", 4), [4]), (t.between("eid", 2, 4), [2, 3, 4]), (t.where("eid", ">", 6), [7, 8])):
        assert sorted(r.eid for r in df.collect()) == want
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan
    assert len(t.lookup("eid", 4).inputFiles()) <= 3


def test_time_layout(spark, tmp_path):
    t = make(spark, tmp_path, [("at", L.Datetime()), ("v", L.Float64)], TimePartition("at", "year-month"))
    t.append(spark.createDataFrame([(dt.datetime(2023, 12, 31, 23), 1.0), (dt.datetime(2024, 1, 1), 2.0)], "at timestamp_ntz, v double"))
    assert {(r.year, r.month) for r in t.scan().collect()} == {(2023, 12), (2024, 1)}
    assert t.lookup("at", dt.datetime(2024, 1, 1)).count() == 1


def test_key_named_column_is_an_error(spark, tmp_path):
    with pytest.raises(TableLayoutError):
        make(spark, tmp_path, [("bucket", L.Mono(4))], MonoPartition("bucket", 3))


def test_ordered_writer(spark, tmp_path):
    t = make(spark, tmp_path, writer_opts=WriterOptions(commit_threshold=4))
    w = t.writer(ordered=True)
    w.stage_frame(ids(spark, [6, 7, 8]), index=1)
    assert not t.exists
    w.stage_frame(ids(spark, [0]), index=0)
    assert t.scan().count() == 4
    w.stage_frame(ids(spark, [1]), index=2)
    assert t.scan().count() == 4  # below the threshold
    with pytest.raises(ValueError):
        w.stage_frame(ids(spark, [1]), index=0)
    w.close()
    assert t.scan().count() == 5
    w = t.writer(ordered=True)
    w.stage_frame(ids(spark, [2]), index=5)
    with pytest.raises(RuntimeError):
        w.close()
    t.writer().close()  # the lock has gone all the same


def test_lock_and_recovery(spark, tmp_path):
    t = make(spark, tmp_path, by=None, writer_opts=WriterOptions(rows_per_file=3))
    t.append(ids(spark, range(2)))
    w = t.writer()
    with pytest.raises(LockedTableError):
        t.writer()
    done = []
    apply = w._apply

    def stop_half_way(moves, mark=None):
        apply(moves[:1])
        done.extend(moves)
        raise OSError("stopped")

    w._apply = stop_half_way
    with pytest.raises(OSError):
        w.stage_frame(ids(spark, range(2, 8)))
    assert len(done) == 3
    with t.writer(break_lock=True):
        pass
    assert rows(t) == [(i, f"p{i}") for i in range(8)]


def test_abort_leaves_nothing(spark, tmp_path):
    t = make(spark, tmp_path, writer_opts=WriterOptions(commit_threshold=100))
    with pytest.raises(KeyError), t.writer(ordered=True) as w:
        w.stage_frame(ids(spark, [1]), index=0)
        raise KeyError
    assert not t.exists and not t.files_api.list(f"{t.path}/.staging")


def test_builder(spark, tmp_path):
    wide = TableBuilder(make(spark, tmp_path, [("k", L.Mono(16))], None, "wide"))
    wide.append((2**100,))
    assert int(wide.flush().first().k) == 2**100
    t = make(spark, tmp_path, [("k", L.Mono(4), TypeHints(sort="desc", unique=True)), ("v", L.String)], None)
    b = TableBuilder(t)
    assert b.flush() is None and b.extend([(2, "b"), (1, "a"), (2, "x"), (3, "c")]) == 3 and b.rows() == 3
    with pytest.raises(ValueError):
        b.flush(5)
    assert b.flush(5, allow_underfilled=True) is None and b.rows() == 3
    assert [r.k for r in b.flush(2).collect()] == [2, 1] and b.rows() == 1
    assert [r.k for r in b.flush(5, drain=True).collect()] == [3]
    b.append((9, None))
    with pytest.raises(ValueError, match="v has nulls"):
        b.flush()
    assert b.rows() == 1
    b.buffer = [(1,)]
    with pytest.raises(ValueError):
        b.flush()
    t.append(spark.createDataFrame([(5, "x")], t.struct))
    b = TableBuilder(t, scope="table")
    b.extend([(5, "y"), (6, "z")])
    assert [r.k for r in b.flush().collect()] == [6]


def test_greedy_frame_matches_rows(spark):
    data = [(i, (i * 7) % 11, (i * 5) % 13) for i in range(120)] + [(200, None, 3), (201, None, None), (202, 99, None)]
    want, seen = [], (set(), set())
    for i, a, b in data:
        if a in seen[0] or b in seen[1]:
            continue
        want.append(i)
        seen[0].update({a} - {None})
        seen[1].update({b} - {None})
    df = spark.createDataFrame(data, "i int, a int, b int")
    assert sorted(r.i for r in greedy_unique(df, ["a", "b"], ["i"]).collect()) == want
    assert sorted(r.i for r in keep_first(df, "a", ["i"]).collect()) == [*range(11), 200, 201, 202]
    assert anti_existing(df, df.where("i < 50"), ["a"]).count() == 3


def test_context(spark, tmp_path):
    t = make(spark, tmp_path, writer_opts=WriterOptions(stage_threshold=2))
    tf = Transform(spark, "doubled", lambda c: c.events.scan().selectExpr("eid * 2 as twice", "bucket"), f"{tmp_path}/doubled", partition_by=["bucket"], include_key=True)
    ctx = Context(spark, [t], [tf])
    b = ContextBuilder(ctx)
    b.push({"events": [(i, None) for i in range(5)]})
    frames = b.frames()
    assert [df.count() for df in frames["events"]] == [2, 2] and b.builders["events"].rows() == 1
    with ctx.writer() as w:
        w.stage_all(frames)
        w.stage_all(b.frames(drain=True))
    assert rows(ctx["events"]) == [(i, None) for i in range(5)] and "doubled" in ctx and "events" in dir(ctx)
    with pytest.raises(FileNotFoundError):
        tf.scan()
    assert ctx.ensure_cache() == {"events": 5, "doubled": 5}
    assert sorted(r.twice for r in ctx.doubled.scan().collect()) == [0, 2, 4, 6, 8]
    t.append(ids(spark, [9]))
    assert ctx.ensure_cache() == {"events": 6, "doubled": 5} and ctx.ensure_cache(regen=True)["doubled"] == 6
    assert tf.disk_size > 0 and tf.is_cached
    ctx.register_views()
    assert spark.sql("select count(*) from events").first()[0] == 6
    with pytest.raises(AttributeError):
        _ = ctx.none
    with pytest.raises(KeyError):
        ctx["none"]
    with pytest.raises(RuntimeError), ctx.writer() as w:
        w.stage_frame("none", ids(spark, [1]))
    assert Context(spark, [t], datadir=f"{tmp_path}/other").events.path.endswith("/other/events")


@pytest.mark.parametrize("format", ["csv", "ipc", "parquet"])
def test_transform_formats(spark, tmp_path, format):
    tf = Transform(spark, "t", spark.range(5), f"{tmp_path}/cache", format, prepare=lambda d: d.selectExpr("id", "id % 2 as odd"))
    assert sorted(int(r.id) for r in tf.scan().collect()) == list(range(5))
    tf.clear_cache()
    assert not tf.is_cached


def test_formats_and_sinks(spark, tmp_path):
    assert [format_from_path(p) for p in ("a.csv", "a.arrow", "a.parquet.tmp", "http://x/a.parquet?b=c.csv")] == ["csv", "ipc", "parquet", "parquet"]
    with pytest.raises(ValueError):
        format_from_path("a")
    with pytest.raises(ValueError):
        sink_files(spark.range(1), str(tmp_path / "x"), partition_by=["id"])
    df = spark.createDataFrame([(1, [1.5, None], {"a": 1})], "i int, xs array<double>, s struct<a:int>")
    sink_files(df, str(tmp_path / "n.ipc"))
    assert scan_files(spark, str(tmp_path / "n.ipc")).collect() == df.collect()


@contextmanager
def served(body, tag):
    hits = []

    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):
            hits.append(("HEAD", self.path))
            if self.path == "/old.parquet":
                self.send_response(302)
                self.send_header("Location", f"http://127.0.0.1:{server.server_port}/new.parquet")
            else:
                self.send_response(200)
                if tag[0]:
                    self.send_header("ETag", f'W/"{tag[0]}"')
            self.end_headers()

        def do_GET(self):
            hits.append(("GET", self.path))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body[0])

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}/old.parquet", hits
    finally:
        server.shutdown()


def test_remote(spark, tmp_path):
    def content(n):
        out = io.BytesIO()
        pq.write_table(pa.table({"id": pa.array(range(n), pa.int64())}), out)
        return out.getvalue()

    body, tag = [content(3)], ["v1"]
    with served(body, tag) as (url, hits):
        t = Table(spark, "far", url, [("id", L.Int64)], datadir=str(tmp_path))
        assert t.remote and t.scan().count() == 3 and t.files()[0].endswith("/remote/far/v1.parquet")
        t.scan(use_cache=False)
        assert sum(m == "GET" for m, _ in hits) == 1
        body[0], tag[0] = content(5), "v2"
        assert t.scan(use_cache=False).count() == 3 and t.scan(refresh=True).count() == 5 and len(t.files()) == 1
        tag[0] = ""
        with pytest.raises(ValueError, match="ETag"):
            remote.fetch(url, tmp_path)
        with pytest.raises(ValueError):
            t.writer()


def test_stream_batches_commit_once(spark, tmp_path):
    t = make(spark, tmp_path)
    sink = TableSink(t)
    sink(ids(spark, [1, 2]), 0)
    sink(ids(spark, [1, 2]), 0)
    sink(ids(spark, [3]), 1)
    assert TableSink(t).last() == 1 and rows(t) == [(i, f"p{i}") for i in (1, 2, 3)]


def test_hot_bucket_is_split(spark, tmp_path):
    t = make(spark, tmp_path, by=MonoPartition("eid", 10**9), writer_opts=WriterOptions(rows_per_file=50))
    t.append(spark.range(1000).selectExpr("id as eid", "cast(null as string) as payload"))
    lens = row_lens(spark, t.files(), "parquet", t.struct)
    assert len(lens) == 20 and set(lens.values()) == {50}


def test_instants_keep_their_days_whatever_the_session_zone(spark, tmp_path):
    """Keys are those of the column's zone, and a lookup equals the filter on the scan for moments of any zone."""
    import datetime as dt

    from appendlake import Table, TimePartition
    from appendlake import types as L

    utc = dt.timezone.utc
    rows = [(i, dt.datetime(2023, 12, 31, 20, 0, tzinfo=utc) + dt.timedelta(hours=i)) for i in range(12)]
    for zone in ("UTC", "America/New_York"):
        for session in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", session)
            try:
                t = Table(spark, "t", f"{tmp_path}/{zone}-{session}".replace("America/", ""), [("i", L.Int64), ("at", L.Datetime("us", zone))], partitioning=TimePartition("at", "year"))
                t.append(spark.createDataFrame(rows, "i bigint, at timestamp"))
                want = {i: (at.astimezone(dt.timezone(dt.timedelta(hours=-5 if zone != "UTC" else 0)))).year for i, at in rows}
                assert {r.i: r.year for r in t.scan().collect()} == want
                for hours in (-5, 0, 9):
                    moment = dt.datetime(2023, 12, 31, 23, 0, tzinfo=utc).astimezone(dt.timezone(dt.timedelta(hours=hours))) + dt.timedelta(hours=2)
                    for op in ("=", "<", "<=", ">", ">="):
                        whole = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
                        assert {r.i for r in t.where("at", op, moment).collect()} == {i for i, at in rows if whole(at, moment)}, (zone, session, op)
                naive = dt.datetime(2024, 1, 1, 3, 0)
                assert t.where("at", ">=", naive).count() == t.scan().where(t.scan()["at"] >= naive).count()
            finally:
                spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_batch_is_committed_once_wherever_the_sink_stops(spark, tmp_path):
    from appendlake import Table
    from appendlake import types as L
    from appendlake.streaming import TableSink

    df = spark.range(10).withColumnRenamed("id", "i")
    for at in ("journal", "moves", "mark"):
        t = Table(spark, "t", f"{tmp_path}/{at}", [("i", L.Int64)])
        w = t.writer()
        if at == "journal":  # before it is written
            w._write = lambda *_: 1 / 0
        elif at == "moves":
            w._apply = lambda *_: 1 / 0
        else:
            w._apply = lambda moves, mark, f=w._apply: (f(moves), 1 / 0)
        with pytest.raises(ZeroDivisionError):
            w.stage_frame(df, mark=(TableSink(t).mark, "0"))
        sink = TableSink(t, break_lock=True)
        for batch in (0, 0, 1):
            sink(df, batch)
        assert t.scan().count() == 20 and sink.last() == 1
