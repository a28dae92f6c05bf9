"""Queries of the library's surface: files, metadata, builders, transforms, streaming windows, and Spark operators over tables. ORACLE_SQL says the same to DuckDB."""

from __future__ import annotations

import contextlib
import datetime
import io
import os
import warnings
from collections.abc import Callable
from typing import Any

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import types as L
from .context import Context
from .errors import AppendlakeWarning, TableLayoutError
from .operators.builder import TableBuilder
from .operators.commit import WriterOptions
from .operators.dedupe import bloom_params
from .operators.quantiles import exact_quantile
from .operators.scratch import Scratch
from .plans.partitioning import DictionaryPartition, MonoPartition, RowLenPartition, TimePartition
from .schema import Schema
from .sources import remote
from .sources.files import data_root, format_from_path, parquet_options, row_len, row_lens
from .streaming import TableSink
from .table import Table
from .tables import CUSTOMER, EVENTS, FIXTURES, LINEITEM, NATION, ORDERS, PART, SUPPLIER, new_table, source, stored
from .transform import Transform
from .types import TypeHints


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _orders(spark: SparkSession, sf_dir: str, **more: Any) -> Table:
    return stored(spark, sf_dir, "orders", ORDERS, MonoPartition("o_orderkey", 1000), **more)


# -- files and metadata


def path_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ["a/b.csv", "b.ipc", "c.arrow", "d.feather", "e.parquet", "f.pq", "https://x.org/g.csv?y=1.pq", "h.parquet.tmp"]
    return _rows(spark, [(p, format_from_path(p)) for p in paths], "path string, format string")


def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part files of a bucketed table: how many, whether it exists and takes room, and whether they are in order."""
    t = _orders(spark, sf_dir, writer_opts=WriterOptions(rows_per_file=300))
    names = t.files()
    return _rows(spark, [(len(names), t.exists, t.disk_size > 0, names == sorted(names), sum(t.part_index(n.rpartition("/")[2]) is not None for n in names))], "n bigint, is_there boolean, takes_room boolean, in_order boolean, numbered bigint")


def file_row_lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each part of a parquet and of an IPC table, from footers, and of one file alone."""
    out = []
    for form in ("parquet", "ipc"):
        t = stored(spark, sf_dir, "supplier", SUPPLIER, format=form, writer_opts=WriterOptions(rows_per_file=7))
        lens = row_lens(spark, t.files(), form, t.struct)
        out += [(form, i, n) for i, n in enumerate(lens[p] for p in t.files())]
        out.append((f"{form} alone", 0, row_len(spark, t.files()[0], form)))
    return _rows(spark, out, "kind string, file_no int, n bigint")


def data_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = os.environ.get("APPENDLAKE_DATADIR")
    os.environ["APPENDLAKE_DATADIR"] = "/data/set"
    try:
        t = Table(spark, "n", "some/n", NATION)
        return _rows(spark, [(data_root(), t.path, t.part_file(7), Table(spark, "n", "/abs/n", NATION, prefix="p", suffix="pq").part_file(12))], "root string, path string, part string, named string")
    finally:
        if before is None:
            del os.environ["APPENDLAKE_DATADIR"]
        else:
            os.environ["APPENDLAKE_DATADIR"] = before


class _Reply(io.BytesIO):
    def __init__(self, body: bytes, headers: dict[str, str]):
        super().__init__(body)
        self.headers = headers


class _Server:
    """Answers for one file: a redirect of one hop, an ETag, and a count of downloads."""

    def __init__(self, body: bytes):
        self.body, self.tag, self.gets = body, "v1", 0

    def __call__(self, url: str, method: str = "GET") -> _Reply:
        if url.endswith("/latest"):
            return _Reply(b"", {"Location": "https://files.example/nation.parquet"})
        self.gets += method == "GET"
        return _Reply(self.body if method == "GET" else b"", {"ETag": f'W/"{self.tag}"'})


def _remote(spark: SparkSession, sf_dir: str, name: str = "nation") -> tuple[_Server, Table]:
    body = io.BytesIO()
    pq.write_table(source(spark, sf_dir, name).toArrow(), body)  # a fixture of 25 rows
    server = _Server(body.getvalue())
    return server, Table(spark, name, "https://files.example/latest", NATION, format="parquet", opener=server, datadir=Scratch(spark).root)


def remote_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _remote(spark, sf_dir)[1].scan()


def remote_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads after one scan, a second one, a refresh with the same tag and one with another."""
    server, t = _remote(spark, sf_dir)
    out = []
    for step, refresh, tag in (("first", False, "v1"), ("again", False, "v1"), ("same tag", True, "v1"), ("new tag", True, "v2")):
        server.tag = tag
        rows = t.scan(use_cache=False, refresh=refresh).count()
        out.append((step, server.gets, len(t.files()), rows))
    return _rows(spark, out, "step string, downloads int, files int, n bigint")


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    server = _Server(b"")
    return _rows(spark, [(u, remote.solve_redirect(u, server), remote.is_remote(u)) for u in ("https://files.example/latest", "https://files.example/other")] + [("/a/b", "/a/b", remote.is_remote("/a/b"))], "url string, leads_to string, is_remote boolean")


def compressed_ipc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An IPC table compressed and not: the same rows, in less room."""
    small, large = (stored(spark, sf_dir, "customer", CUSTOMER, format="ipc", compression=c) for c in ("zstd", "uncompressed"))
    smaller = small.disk_size < large.disk_size
    return small.scan().select("c_custkey", "c_name", F.lit(smaller).alias("smaller"))


def compression_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level that follows from how many columns are text or nested, and given ones."""
    nested = [("a", L.Int64), ("b", L.List(L.Int64))]
    made = [
        ("numbers", Table(spark, "t", "/t", [("a", L.Int64), ("b", L.Int64)])), ("half text", Table(spark, "t", "/t", [("a", L.Int64), ("b", L.String)])), ("text", Table(spark, "t", "/t", [("a", L.String), ("b", L.String), ("c", L.Int64)])),
        ("nested", Table(spark, "t", "/t", nested)), ("given", Table(spark, "t", "/t", nested, compression_level=3)),
    ]
    return _rows(spark, [(n, t.compression_level) for n, t in made], "name string, level int")


def dictionary_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = parquet_options(Schema(ORDERS), 6, "zstd")
    return _rows(spark, [(k.partition("#")[2], v) for k, v in options.items() if "#" in k], "name string, dictionary string")


def codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas, tables, types and partition specs through their encodings and back."""
    out = []
    for name, columns in FIXTURES.items():
        s = Schema(columns)
        out.append((f"schema {name}", Schema.from_json(s.to_json()) == s and Schema.of(s.to_spark()).columns == s.columns and len(s) == len(columns)))
    for by in (MonoPartition("o_orderkey", 10), RowLenPartition(row_size=5), TimePartition("o_orderdate", "year-month"), DictionaryPartition("o_orderpriority", 2, lowercase=True)):
        t = Table(spark, "orders", "/x/orders", ORDERS, partitioning=by)
        out.append((f"table {by.tag}", Table.decode(spark, t.to_json()) == t and type(by).decode(by.encode()) == by))
    for kind in (L.Mono(4), L.Datetime("ms", "UTC"), L.Decimal(12, 2), L.List(L.Struct(a=L.Int32, b=L.String)), L.Array(L.Float32, 3)):
        out.append((f"type {kind.tag}", L.LogicalType.decode(kind.encode()) == kind))
    t = Table(spark, "a", "/x/a", NATION)
    out.append(("copy", t.copy(name="b").name == "b" and t.copy() == t and t.copy(format="csv").format == "csv"))
    return _rows(spark, out, "what string, same boolean")


def schema_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for name, columns in {"orders": ORDERS, "events": EVENTS, "nested": [("a", L.Int64), ("b", L.List(L.Int64))]}.items():
        s = Schema(columns)
        out.append((name, *(",".join(c.name for c in part) for part in (s.numeric_columns, s.string_columns, s.nested_columns)), name in Table(spark, name, "/x", columns).pretty_str()))
    return _rows(spark, out, "name string, numeric string, texts string, nested string, printed boolean")


def layout_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs that don't fit their column, and one that only warns."""
    cases = [
        ("mono of a plain number", MonoPartition("c_custkey")), ("time of a text", TimePartition("c_name")), ("no such column", MonoPartition("nothing")), ("unknown kind", TimePartition("d", "week")),
        ("key named like a column", RowLenPartition()), ("nested", DictionaryPartition("l")), ("unpadded number", DictionaryPartition("c_custkey")), ("fits", DictionaryPartition("c_name")),
    ]
    columns, out = [*CUSTOMER, ("d", L.Date), ("l", L.List(L.Int64))], []
    for name, by in cases:
        own = [*columns, ("bucket", L.Int64)] if name == "key named like a column" else columns
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            try:
                Table(spark, "t", "/x", own, partitioning=by)
                said = "warning" if any(issubclass(w.category, AppendlakeWarning) for w in seen) else "none"
            except (TableLayoutError, ValueError) as e:
                said = type(e).__name__
        out.append((name, said))
    return _rows(spark, out, "what string, raised string")


def bloom_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, [(n, p, *bloom_params(n, p)) for n, p in ((1000, 0.01), (1_000_000, 0.001), (30_000_000, 0.001))], "n int, p double, bits bigint, hashes int")


# -- builders, writers, contexts


def builder_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A builder's rows as they come and go: appended, refused, flushed by a target, drained."""
    columns = [("s_suppkey", L.Int64, TypeHints(unique=True)), ("s_name", L.String)]
    b, out = TableBuilder(new_table(spark, "s", columns)), []
    rows = [(i % 12, f"r{i}") for i in range(20)]
    out.append(("taken", b.extend(rows)))
    out.append(("held", b.rows()))
    out.append(("a frame of 5", b.flush(5).count()))
    out.append(("held then", b.rows()))
    out.append(("none of 50", 0 if b.flush(50, allow_underfilled=True) is None else 1))
    out.append(("drained", b.flush(50, drain=True).count()))
    out.append(("left", b.rows()))
    return _rows(spark, out, "step string, n bigint")


def drained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered frames under the commit threshold wait, and a writer that closes commits them."""
    orders = source(spark, sf_dir, "orders")
    t = new_table(spark, "orders", [(n, k) for n, k, *_ in ORDERS], MonoPartition("o_orderkey", 1000), writer_opts=WriterOptions(commit_threshold=10**9))
    with t.writer(ordered=True) as w:
        for i in (1, 0):
            w.stage_frame(orders.where(f"o_orderkey % 2 = {i}"), index=i)
        waiting, there = len(w.waiting), t.exists
    return t.scan().groupBy().agg(F.count("*").alias("n"), F.lit(waiting).cast("bigint").alias("waiting"), F.lit(there).alias("early"))


def refused_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second writer, a null in a column that isn't optional, a row that is too short, and an abort: nothing is stored."""
    t, out = new_table(spark, "n", NATION), []

    def tried(name: str, do: Callable[[], Any]) -> None:
        try:
            do()
            out.append((name, "none"))
        except Exception as e:  # noqa: BLE001  its name is the result
            out.append((name, type(e).__name__))

    with t.writer():
        tried("second writer", t.writer)
    b = TableBuilder(t)
    b.extend([(1, None, 2)])
    tried("null", b.flush)
    b = TableBuilder(t)
    b.extend([(1, "x")])
    tried("short row", b.flush)
    with contextlib.suppress(KeyError), t.writer(ordered=True) as w:
        w.stage_frame(source(spark, sf_dir, "nation"), index=3)
        raise KeyError
    out.append(("stored", str(t.scan().count())))
    return _rows(spark, out, "what string, raised string")


def recovered_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit that stops between its moves is finished by the next writer."""
    t, orders = new_table(spark, "orders", ORDERS, MonoPartition("o_orderkey", 100)), source(spark, sf_dir, "orders")
    w = t.writer()
    apply = w._apply
    w._apply = lambda moves, mark=None: (apply(moves[: len(moves) // 2]), 1 / 0)
    with contextlib.suppress(ZeroDivisionError):
        w.stage_frame(orders)
    t.writer(break_lock=True).close()
    return t.scan().select("o_orderkey", "o_custkey")


def context_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and transforms by item, attribute and view; ensure_cache counts the rows of all."""
    tables = [stored(spark, sf_dir, "nation", NATION), stored(spark, sf_dir, "customer", CUSTOMER)]
    busy = Transform(spark, "busy", lambda c: c.customer.scan().groupBy("c_nationkey").agg(F.count("*").alias("n")), f"{Scratch(spark).root}/busy")
    ctx = Context(spark, tables, [busy])
    rows = ctx.ensure_cache(regen=True)
    ctx.register_views()
    found = spark.sql("select n_name, n from busy join nation on c_nationkey = n_nationkey")
    return found.withColumns({"same": F.lit(ctx["busy"] is ctx.busy and "nation" in ctx and "customer" in dir(ctx)), "rows_customer": F.lit(rows["customer"]).cast("bigint"), "rows_busy": F.lit(rows["busy"]).cast("bigint")})


def transform_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transform's cache: prepared rows, kept when the query changes, and computed anew once cleared."""
    nation, out = source(spark, sf_dir, "nation"), []
    tf = Transform(spark, "some", nation, f"{Scratch(spark).root}/some", prepare=lambda df: df.where("n_regionkey = 1"))
    out.append(("before", tf.is_cached, 0))
    out.append(("prepared", True, tf.scan().count()))
    tf.query = nation.limit(0)
    out.append(("kept", tf.is_cached and tf.disk_size > 0, tf.scan(use_cache=False).count()))
    tf.clear_cache()
    out.append(("cleared", tf.is_cached, tf.scan().count()))
    return _rows(spark, out, "step string, cached boolean, n bigint")


# -- keys


def dict_numeric_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = source(spark, sf_dir, "part").select((F.col("p_partkey") - 500).alias("p_partkey"), "p_name")
    t = stored(spark, sf_dir, "part", PART, DictionaryPartition("p_partkey", 3, pad_to=6, signed=True), df=part)
    return t.scan().select("p_partkey", "char0", "char1", "char2")


def _instants(spark: SparkSession, sf_dir: str) -> Table:
    columns = [("event_id", L.Mono(4)), ("at", L.Datetime("us", "UTC"))]
    events = source(spark, sf_dir, "events").select("event_id", F.expr("cast(ts + interval '0' day as timestamp_ntz)").alias("ts"))
    at = F.expr("timestamp_micros(cast(unix_micros(convert_timezone('UTC', current_timezone(), ts)::timestamp) as bigint))")
    return stored(spark, sf_dir, "instants", columns, TimePartition("at", "year-month-day"), df=events.select("event_id", at.alias("at")))


def time_zone_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants stored by UTC days, looked up between two moments given five hours west: rows of the days around are found."""
    zone = datetime.timezone(datetime.timedelta(hours=-5))
    low, high = datetime.datetime(2024, 1, 2, 20, 0, tzinfo=zone), datetime.datetime(2024, 1, 4, 22, 30, tzinfo=zone)
    return _instants(spark, sf_dir).between("at", low, high).select("event_id", F.col("day").cast("bigint").alias("day"))


# -- Spark operators over tables


def join_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left, right and full joins of customers and their orders, counted."""
    c, o = stored(spark, sf_dir, "customer", CUSTOMER).scan(), _orders(spark, sf_dir).scan()
    made = []
    for how in ("left", "right", "full"):
        j = c.join(o.where("o_orderkey % 3 = 0"), c["c_custkey"] == o["o_custkey"], how)
        made.append(j.agg(F.lit(how).alias("how"), F.count("*").alias("n"), F.count("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders")))
    return made[0].unionByName(made[1]).unionByName(made[2])


def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = stored(spark, sf_dir, "customer", CUSTOMER).scan(), _orders(spark, sf_dir).scan()
    return c.join(o.where("o_totalprice > 200000"), c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the suppliers of their nation that have more on account: an equality and an inequality."""
    s = source(spark, sf_dir, "supplier")
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, F.expr("a.s_nationkey = b.s_nationkey and a.s_acctbal < b.s_acctbal")).groupBy(F.col("a.s_suppkey").alias("s_suppkey")).agg(F.count("*").alias("richer"))


def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations times regions, 25 by 5."""
    n, r = stored(spark, sf_dir, "nation", NATION).scan(), source(spark, sf_dir, "region")
    return n.crossJoin(F.broadcast(r)).select("n_name", "r_name", (F.col("n_regionkey") == F.col("r_regionkey")).alias("home"))


def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of lines and of their orders. A row of each set of flags that an order has is marked, and the marks add up to distinct orders."""
    t = stored(spark, sf_dir, "lineitem", LINEITEM, TimePartition("l_shipdate", "year"))
    f, s, order = "l_returnflag", "l_linestatus", "l_orderkey"
    seen = t.scan().groupBy(order, f, s).agg(F.count("*").alias("n")).repartition(order)
    first = lambda by, then: (F.col(order).isNotNull() & (F.row_number().over(Window.partitionBy(*by).orderBy(*then)) == 1)).cast("bigint")
    marked = seen.select(f, s, "n", F.col(order).isNotNull().cast("bigint").alias("of_both"), first([order, f], [s]).alias("of_flag"), first([order, s], [f]).alias("of_status"), first([order], [f, s]).alias("of_all"))
    small = marked.groupBy(f, s).agg(*(F.sum(c).alias(c) for c in ("n", "of_both", "of_flag", "of_status", "of_all")))
    orders = F.coalesce(*(F.when(F.grouping_id() == i, F.sum(c)) for i, c in enumerate(("of_both", "of_flag", "of_status", "of_all"))))
    return small.cube(f, s).agg(F.sum("n").alias("n"), orders.alias("orders"))


def agg_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "lineitem", LINEITEM, TimePartition("l_shipdate", "year"))
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    return t.scan().groupingSets([(f,), (s,), ()], f, s).agg(F.count("*").alias("n"), F.count_if(F.col("l_linenumber") == 1).alias("firsts"))


def agg_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct counts and medians lie within a tenth of the exact ones. Each is an aggregate of its own: beside a distinct count, the states of the others would be kept for each distinct value."""
    status, customer, price = "o_orderstatus", "o_custkey", "o_totalprice"
    # A task gives a summary of some 10,000 values a group, so that their number has a bound.
    o = Scratch(spark).save(_orders(spark, sf_dir).scan().select(status, customer, price).coalesce(4 * spark.sparkContext.defaultParallelism), "orders")
    near = lambda a, b: F.abs(a - b) <= 0.1 * b
    rough = o.groupBy(status).agg(F.approx_count_distinct(customer, 0.02).alias("rough_n"), F.percentile_approx(price, 0.5, 10_000).alias("rough_median"))
    counts = o.select(status, customer).distinct().groupBy(F.col(status).alias("of_n")).agg(F.count(customer).alias("n"))
    medians = exact_quantile(o, status, price, 0.5).withColumnRenamed(status, "of_median")
    all_of = rough.join(counts, F.col(status).eqNullSafe(F.col("of_n"))).join(medians, F.col(status).eqNullSafe(F.col("of_median")), "left")
    return all_of.select(status, near(F.col("rough_n"), F.col("n")).alias("distinct_near"), near(F.col("rough_median"), F.col("quantile")).alias("median_near"))


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _orders(spark, sf_dir).scan().select(F.col("o_custkey").alias("k")), source(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    named = lambda df, name: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"), F.sum("k").alias("total"))
    return named(o.union(c), "all").unionByName(named(o.union(c).distinct(), "distinct")).unionByName(named(o.intersect(c), "intersect")).unionByName(named(o.intersectAll(c), "intersect all")).unionByName(named(o.exceptAll(c), "except all"))


def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).scan().select("o_orderkey").orderBy("o_orderkey").offset(40).limit(20)


def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stored(spark, sf_dir, "events", EVENTS, TimePartition("ts", "day")).scan()
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id", 2).over(w).alias("after2"), F.dense_rank().over(w).alias("rnk"), F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("last3"))


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes, JSON, regular expressions, arrays and maps."""
    e = stored(spark, sf_dir, "events", EVENTS).scan()
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select("event_id", k.alias("k"), F.md5("event_type").alias("md5"), F.sha2("event_type", 256).alias("sha"), F.regexp_extract("props", r"(\d+)", 1).alias("digits"), F.array_join(F.array_sort(F.array("event_type", F.lit("m"))), "/").alias("joined"), F.element_at(F.create_map(F.lit("a"), k), "a").alias("mapped"))


def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).scan()
    return o.select("o_orderkey", F.pmod(-F.col("o_orderkey"), F.lit(7)).alias("m"), F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("thousands"), F.year("o_orderdate").cast("bigint").alias("y"), F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint").alias("days"), F.upper(F.substring("o_orderpriority", 3, 4)).alias("u"))


def pandas_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vectorised function of one's own over a table's column."""

    @F.pandas_udf("bigint")
    def digits(s: pd.Series) -> pd.Series:
        return s.astype(str).str.len().astype("int64")

    return _orders(spark, sf_dir).scan().select("o_orderkey", digits("o_orderkey").alias("digits"))


# -- streaming


def _stream(spark: SparkSession, sf_dir: str, scratch: Scratch, parts: int = 3) -> DataFrame:
    events = source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = scratch.save(events.repartition(parts), "in").inputFiles()[0].rpartition("/")[0]
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _complete(spark: SparkSession, scratch: Scratch, df: DataFrame) -> DataFrame:
    """The last state of a streamed aggregate."""
    out = f"{scratch.root}/out"
    q = df.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{scratch.root}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    e = _stream(spark, sf_dir, scratch).withWatermark("ts", "40 days").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return _complete(spark, scratch, e).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    e = _stream(spark, sf_dir, scratch).withWatermark("ts", "40 days").groupBy(F.window("ts", "2 days", "1 day")).agg(F.count("*").alias("n"))
    return _complete(spark, scratch, e).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events with gaps of less than a day, from a stream."""
    scratch = Scratch(spark)
    e = _stream(spark, sf_dir, scratch).withWatermark("ts", "40 days").groupBy(F.session_window("ts", "1 day"), "user_id").agg(F.count("*").alias("n"))
    return _complete(spark, scratch, e).select(F.col("session_window.start").cast("timestamp_ntz").alias("began"), "user_id", "n")


def stream_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink that is stopped after its journal and before its moves; the batch comes again, once more and with the next."""
    t = new_table(spark, "events", EVENTS, TimePartition("ts", "day"))
    events = source(spark, sf_dir, "events")
    first, second = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    w = t.writer()
    w._apply = lambda *_: 1 / 0
    with contextlib.suppress(ZeroDivisionError):
        w.stage_frame(first, mark=(TableSink(t).mark, "0"))
    sink = TableSink(t, break_lock=True)
    for df, batch in ((first, 0), (first, 0), (second, 1), (second, 1)):
        sink(df, batch)
    return t.scan().select("event_id", "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        path_formats, table_files, file_row_lens, data_folder, remote_scan, remote_downloads, redirects, compressed_ipc, compression_levels, dictionary_columns, codecs, schema_views, layout_errors, bloom_sizes, builder_rows, drained_rows,
        refused_rows, recovered_commit, context_access, transform_cache, dict_numeric_signed, time_zone_lookup, join_outer, join_semi, join_theta, join_cross, agg_cube, agg_sets, agg_approx, set_ops, page, window_frames, text_functions,
        math_functions, pandas_function, stream_tumbling, stream_sliding, stream_sessions, stream_stopped,
    )
}

_CUSTOMER_ORDERS = "customer c {} JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) o ON c.c_custkey = o.o_custkey"
_SETS = "(SELECT o_custkey AS k FROM orders) {} (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)"

ORACLE_SQL = {
    "path_formats": "SELECT * FROM (VALUES ('a/b.csv', 'csv'), ('b.ipc', 'ipc'), ('c.arrow', 'ipc'), ('d.feather', 'ipc'), ('e.parquet', 'parquet'), ('f.pq', 'parquet'), ('https://x.org/g.csv?y=1.pq', 'csv'), ('h.parquet.tmp', 'parquet')) t(path, format)",
    "table_files": "SELECT CAST(sum(n) AS BIGINT) AS n, true AS is_there, true AS takes_room, true AS in_order, CAST(sum(n) AS BIGINT) AS numbered FROM (SELECT ceil(count(*) / 300) AS n FROM orders GROUP BY o_orderkey // 1000)",
    "file_row_lens": "WITH f AS (SELECT CAST((row_number() OVER (ORDER BY s_suppkey) - 1) // 7 AS INTEGER) AS file_no FROM supplier), n AS (SELECT file_no, count(*) AS n FROM f GROUP BY 1) SELECT kind, file_no, n FROM n, (VALUES ('parquet'), ('ipc')) k(kind) UNION ALL SELECT kind || ' alone', file_no, n FROM n, (VALUES ('parquet'), ('ipc')) k(kind) WHERE file_no = 0",
    "data_folder": "SELECT '/data/set' AS root, '/data/set/some/n' AS path, '00007.parquet' AS part, 'p-00012.pq' AS named",
    "remote_scan": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "remote_downloads": "SELECT step, downloads, files, (SELECT count(*) FROM nation) AS n FROM (VALUES ('first', 1, 1), ('again', 1, 1), ('same tag', 1, 1), ('new tag', 2, 1)) t(step, downloads, files)",
    "redirects": "SELECT * FROM (VALUES ('https://files.example/latest', 'https://files.example/nation.parquet', true), ('https://files.example/other', 'https://files.example/other', true), ('/a/b', '/a/b', false)) t(url, leads_to, is_remote)",
    "compressed_ipc": "SELECT c_custkey, c_name, true AS smaller FROM customer",
    "compression_levels": "SELECT * FROM (VALUES ('numbers', 6), ('half text', 6), ('text', 10), ('nested', 10), ('given', 3)) t(name, level)",
    "dictionary_columns": "SELECT * FROM (VALUES ('o_orderkey', 'false'), ('o_custkey', 'false'), ('o_orderstatus', 'true'), ('o_totalprice', 'false'), ('o_orderdate', 'false'), ('o_orderpriority', 'true')) t(name, dictionary)",
    "codecs": "SELECT what, true AS same FROM (VALUES ('schema author'), ('schema block'), ('schema market'), ('schema pubmed'), ('table mono'), ('table rowlen'), ('table time'), ('table dict'), ('type mono'), ('type datetime'), ('type decimal'), ('type list'), ('type array'), ('copy')) t(what)",
    "schema_views": "SELECT * FROM (VALUES ('orders', 'o_orderkey,o_custkey,o_totalprice,o_orderdate', 'o_orderstatus,o_orderpriority', '', true), ('events', 'event_id,ts,user_id,value', 'event_type,props', '', true), ('nested', 'a', '', 'b', true)) t(name, numeric, texts, nested, printed)",
    "layout_errors": "SELECT * FROM (VALUES ('mono of a plain number', 'TableLayoutError'), ('time of a text', 'TableLayoutError'), ('no such column', 'ValueError'), ('unknown kind', 'ValueError'), ('key named like a column', 'TableLayoutError'), ('nested', 'TableLayoutError'), ('unpadded number', 'warning'), ('fits', 'none')) t(what, raised)",
    "bloom_sizes": "SELECT n, p, CAST(ceil(-n * ln(p) / (ln(2) * ln(2))) AS BIGINT) AS bits, CAST(round(ceil(-n * ln(p) / (ln(2) * ln(2))) / n * ln(2)) AS INTEGER) AS hashes FROM (VALUES (1000, CAST(0.01 AS DOUBLE)), (1000000, CAST(0.001 AS DOUBLE)), (30000000, CAST(0.001 AS DOUBLE))) t(n, p)",
    "builder_rows": "SELECT step, CAST(n AS BIGINT) AS n FROM (VALUES ('taken', 12), ('held', 12), ('a frame of 5', 5), ('held then', 7), ('none of 50', 0), ('drained', 7), ('left', 0)) t(step, n)",
    "drained_rows": "SELECT count(*) AS n, CAST(2 AS BIGINT) AS waiting, false AS early FROM orders",
    "refused_rows": "SELECT * FROM (VALUES ('second writer', 'LockedTableError'), ('null', 'ValueError'), ('short row', 'ValueError'), ('stored', '0')) t(what, raised)",
    "recovered_commit": "SELECT o_orderkey, o_custkey FROM orders",
    "context_access": "WITH b AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT n_name, n, true AS same, (SELECT count(*) FROM customer) AS rows_customer, (SELECT count(*) FROM b) AS rows_busy FROM b JOIN nation ON c_nationkey = n_nationkey",
    "transform_cache": "WITH k AS (SELECT count(*) AS n FROM nation WHERE n_regionkey = 1) SELECT 'before' AS step, false AS cached, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'prepared', true, n FROM k UNION ALL SELECT 'kept', true, n FROM k UNION ALL SELECT 'cleared', false, 0",
    "dict_numeric_signed": "WITH p AS (SELECT p_partkey - 500 AS p_partkey FROM part), t AS (SELECT p_partkey, CASE WHEN p_partkey < 0 THEN '-' || lpad(CAST(-p_partkey AS VARCHAR), 5, '0') ELSE lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS s FROM p) SELECT p_partkey, substr(s, 1, 1) AS char0, substr(s, 2, 1) AS char1, substr(s, 3, 1) AS char2 FROM t",
    "time_zone_lookup": "SELECT event_id, CAST(day(ts) AS BIGINT) AS day FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03 01:00:00' AND TIMESTAMP '2024-01-05 03:30:00'",
    "join_outer": " UNION ALL ".join(f"SELECT '{how}' AS how, count(*) AS n, count(c_custkey) AS customers, count(o_orderkey) AS orders FROM {_CUSTOMER_ORDERS.format(how)}" for how in ("left", "right", "full")),
    "join_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "join_theta": "SELECT a.s_suppkey, count(*) AS richer FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal GROUP BY 1",
    "join_cross": "SELECT n_name, r_name, n_regionkey = r_regionkey AS home FROM nation, region",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(count(*) FILTER (WHERE l_linenumber = 1) AS BIGINT) AS firsts FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "agg_approx": "SELECT o_orderstatus, true AS distinct_near, true AS median_near FROM orders GROUP BY 1",
    "set_ops": " UNION ALL ".join(f"SELECT '{name}' AS op, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM ({_SETS.format(op)})" for name, op in (("all", "UNION ALL"), ("distinct", "UNION"), ("intersect", "INTERSECT"), ("intersect all", "INTERSECT ALL"), ("except all", "EXCEPT ALL"))),
    "page": "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 20 OFFSET 40",
    "window_frames": "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after2, CAST(dense_rank() OVER w AS INTEGER) AS rnk, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "text_functions": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, md5(event_type) AS md5, sha256(event_type) AS sha, regexp_extract(props, '(\\d+)', 1) AS digits, array_to_string(list_sort([event_type, 'm']), '/') AS joined, CAST(props->>'$.k' AS BIGINT) AS mapped FROM events",
    "math_functions": "SELECT o_orderkey, CAST((7 - o_orderkey % 7) % 7 AS BIGINT) AS m, CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, upper(substr(o_orderpriority, 3, 4)) AS u FROM orders",
    "pandas_function": "SELECT o_orderkey, CAST(length(CAST(o_orderkey AS VARCHAR)) AS BIGINT) AS digits FROM orders",
    "stream_tumbling": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT CAST(day AS TIMESTAMP) AS day, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS day FROM events) GROUP BY 1",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT min(ts) AS began, user_id, count(*) AS n FROM s GROUP BY user_id, s",
    "stream_stopped": "SELECT event_id, value FROM events",
}
