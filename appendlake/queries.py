"""The registry: each query goes through the engine (write, then scan); ORACLE_SQL says the same to DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import api_queries
from . import types as L
from .context import Context, ContextBuilder
from .operators.builder import checked, null_audit
from .operators.commit import WriterOptions
from .operators.dedupe import greedy_unique
from .operators.scratch import Scratch
from .plans.partitioning import DictionaryPartition, MonoPartition, RowLenPartition, TimePartition
from .schema import Schema
from .streaming import TableSink, first_within_watermark
from .table import Table
from .tables import CUSTOMER, EMBEDDINGS, EVENTS, FIXTURES, LINEITEM, NATION, ORDERS, PART, SUPPLIER, new_table, source, stored
from .transform import Transform
from .types import TypeHints

def _orders(spark: SparkSession, sf_dir: str, **more: Any) -> Table:
    return stored(spark, sf_dir, "orders", ORDERS, MonoPartition("o_orderkey", 1000), **more)


def _by_time(name: str, columns: Any, column: str, kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = stored(spark, sf_dir, name, columns, TimePartition(column, kind))
        parts = t.partitioning.parts
        return t.scan().groupBy(*(F.col(p).cast("bigint").alias(p) for p in parts)).agg(F.count("*").alias("n"))

    return run


def mono_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).scan().select("o_orderkey", "o_custkey", "o_totalprice", "bucket")


def mono_bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).scan().groupBy("bucket").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


def mono_bucket_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).scan().where("bucket = 0").select("o_orderkey", "o_custkey")


def mono_range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).between("o_orderkey", 250, 1250).select("o_orderkey", "o_totalprice")


def dict_string_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "customer", CUSTOMER, DictionaryPartition("c_mktsegment")).scan().select("c_custkey", "c_mktsegment", "char0")


def dict_string_depth2_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "part", PART, DictionaryPartition("p_name", 2, lowercase=True))
    return t.scan(exact_keys=True).groupBy("char0", "char1").agg(F.count("*").alias("n"))


def dict_numeric_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "part", PART, DictionaryPartition("p_partkey", 6, pad_to=8))
    return t.scan().select("p_partkey", "char4", "char5")


def dict_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "customer", CUSTOMER, DictionaryPartition("c_mktsegment"))
    return t.lookup("c_mktsegment", "BUILDING").select("c_custkey", "c_name")


def rowlen_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "part", PART, RowLenPartition(row_size=100)).scan().groupBy("bucket").agg(F.count("*").alias("n"))


def _unique_users() -> list:
    return [(n, t, TypeHints(unique=True) if n == "user_id" else (h or [TypeHints()])[0]) for n, t, *h in EVENTS]


def unique_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = new_table(spark, "events", _unique_users())
    t.append(checked(source(spark, sf_dir, "events"), t, ["event_id"]))
    return t.scan().select("user_id", "event_id")


def unique_table_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [(n, t, TypeHints(unique=True, sort="asc") if n == "o_orderkey" else (h or [TypeHints()])[0]) for n, t, *h in ORDERS]
    orders = source(spark, sf_dir, "orders")
    t = new_table(spark, "orders", columns, MonoPartition("o_orderkey", 1000))
    t.append(orders.where("o_orderkey < 100"))
    return checked(orders.select(*t.schema.names), t, ["o_orderkey"], scope="table").select("o_orderkey")


def unique_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of events whose (user, type and minute) and (type and value) are both new, in the order of event_id."""
    e = source(spark, sf_dir, "events").select("event_id", F.concat_ws("/", "user_id", "event_type").alias("a"), F.concat_ws("/", "event_type", F.floor("value")).alias("b"))
    return greedy_unique(e, ["a", "b"], ["event_id"]).select("event_id", "a", "b")


def _positions(t: Table) -> DataFrame:
    name = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.", 1).cast("bigint")
    return t.scan().select("*", name.alias("file_no"), F.col("_metadata.row_index").alias("row_index"))


def rolled_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _orders(spark, sf_dir, writer_opts=WriterOptions(rows_per_file=300))
    return _positions(t).groupBy("bucket", "file_no").agg(F.count("*").alias("n"))


def topped_up_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As rolled_file_rows, from three commits that top up the last part of a bucket."""
    t = new_table(spark, "orders", ORDERS, MonoPartition("o_orderkey", 1000), writer_opts=WriterOptions(rows_per_file=300))
    orders = source(spark, sf_dir, "orders")
    with t.writer() as w:
        for lo, hi in ((0, 130), (130, 777), (777, 1000)):
            w.stage_frame(orders.where(f"o_orderkey % 1000 >= {lo} and o_orderkey % 1000 < {hi}"))
    return _positions(t).groupBy("bucket", "file_no").agg(F.count("*").alias("n"))


def sorted_desc_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [(n, t, TypeHints(sort="desc") if n == "o_orderkey" else (h or [TypeHints()])[0]) for n, t, *h in ORDERS]
    t = stored(spark, sf_dir, "orders", columns, MonoPartition("o_orderkey", 1000), writer_opts=WriterOptions(rows_per_file=300))
    return _positions(t).select("o_orderkey", (F.col("file_no") * 300 + F.col("row_index") + 1).alias("pos"))


def append_two_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = source(spark, sf_dir, "orders")
    t = new_table(spark, "orders", ORDERS, MonoPartition("o_orderkey", 1000))
    t.append(orders.where("o_orderkey < 500"))
    t.append(orders.where("o_orderkey >= 500"))
    return t.scan().select("o_orderkey", "o_custkey")


def ordered_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames 2, 0 and 1 arrive; the gap holds frame 2 back, and all are stored in the order of their indexes."""
    columns = [(n, t) for n, t, *_ in ORDERS]
    orders = source(spark, sf_dir, "orders")
    t = new_table(spark, "orders", columns, MonoPartition("o_orderkey", 1_000_000_000), writer_opts=WriterOptions(commit_threshold=1, rows_per_file=10_000_000))
    with t.writer(ordered=True) as w:
        for i in (2, 0, 1):
            w.stage_frame(orders.where(f"o_orderkey % 3 = {i}"), index=i)
    seen = _positions(t).select((F.col("o_orderkey") % 3).alias("frame"), (F.col("file_no") * t.options.rows_per_file + F.col("row_index")).alias("row"))
    return seen.groupBy("frame").agg(F.min("row").alias("first_row"), F.count("*").alias("n"))


def empty_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_table(spark, "orders", ORDERS, MonoPartition("o_orderkey", 1000)).scan().select("o_orderkey", "bucket")


def null_audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = new_table(spark, "events", EVENTS)
    return null_audit(source(spark, sf_dir, "events"), t).select("null_ts", "null_value")


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "nation", NATION, format="csv").scan()


def ipc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "supplier", SUPPLIER, format="ipc").scan()


def nested_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "embeddings", EMBEDDINGS).scan().select("vec_id", F.size("embedding").cast("bigint").alias("width"))


def builder_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through a context's builder, exact frames, writer and scan."""
    t = new_table(spark, "nation", NATION, writer_opts=WriterOptions(stage_threshold=10))
    ctx = Context(spark, [t])
    b = ContextBuilder(ctx)
    b.extend("nation", ((r.n_nationkey, r.n_name, r.n_regionkey) for r in source(spark, sf_dir, "nation").toLocalIterator()))
    with ctx.writer() as w:
        w.stage_all(b.frames(drain=True))
    return ctx.nation.scan()


def _transform(spark: SparkSession, name: str, query: Any, **more: Any) -> Transform:
    return Transform(spark, name, query, f"{Scratch(spark).root}/{name}", **more)


def transform_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [stored(spark, sf_dir, "customer", CUSTOMER), stored(spark, sf_dir, "nation", NATION)]
    tf = _transform(spark, "customers", lambda c: c.customer.scan().join(c.nation.scan(), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers")))
    ctx = Context(spark, tables, [tf])
    ctx.customers.scan(ctx)
    return ctx.customers.scan(use_cache=False)


def transform_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = _transform(spark, "by_status", source(spark, sf_dir, "orders"), partition_by=["o_orderstatus"], include_key=True, per_partition_sort_by=["o_orderkey"])
    return tf.scan().groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def ohlc_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stored(spark, sf_dir, "events", EVENTS, TimePartition("ts", "day")).scan()
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"))


def schema_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {n: Schema(c) for n, c in FIXTURES.items()}
    return spark.createDataFrame([(n, s.avg_row_size, s.row_group_size) for n, s in made.items()], "name string, avg_row_size int, row_group_size int")


def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _orders(spark, sf_dir).scan(), source(spark, sf_dir, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy("o_orderkey").agg(F.count("*").alias("lines"))


def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _orders(spark, sf_dir).scan(), source(spark, sf_dir, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"], "left_anti").select("o_orderkey")


def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stored(spark, sf_dir, "events", EVENTS, MonoPartition("event_id", 1000)).scan()
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return e.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("prev_purchase"))


def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "lineitem", LINEITEM, TimePartition("l_shipdate", "year-month"))
    return t.scan().rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _orders(spark, sf_dir).scan().select("o_orderkey", F.row_number().over(w).alias("rnk"))


def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).scan().select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _orders(spark, sf_dir).scan().select(F.col("o_orderkey").alias("k"))
    return k.subtract(source(spark, sf_dir, "lineitem").select("l_orderkey"))


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events, streamed into a table batch by batch; the same batches again change nothing."""
    t = new_table(spark, "events", EVENTS, TimePartition("ts", "day"))
    schema = source(spark, sf_dir, "events").schema
    scratch = Scratch(spark)
    folder = scratch.save(source(spark, sf_dir, "events").repartition(3), "in").inputFiles()[0].rpartition("/")[0]
    sink = TableSink(t)
    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).writeStream.foreachBatch(sink).option("checkpointLocation", f"{scratch.root}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.scan().select("event_id", "user_id", "event_type", "value")


def stream_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users that a watermarked stream of events passes once each (all of them: the delay spans the events)."""
    scratch = Scratch(spark)
    folder = scratch.save(source(spark, sf_dir, "events"), "in").inputFiles()[0].rpartition("/")[0]
    e = spark.readStream.schema(source(spark, sf_dir, "events").schema).parquet(folder)
    out = f"{scratch.root}/out"
    q = first_within_watermark(e, "user_id", "ts", "60 days").select("user_id").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{scratch.root}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "mono_roundtrip": mono_roundtrip, "mono_bucket_stats": mono_bucket_stats, "mono_bucket_prune": mono_bucket_prune, "mono_range_lookup": mono_range_lookup,
    "time_year": _by_time("orders", ORDERS, "o_orderdate", "year"), "time_month": _by_time("orders", ORDERS, "o_orderdate", "month"), "time_day": _by_time("events", EVENTS, "ts", "day"),
    "time_year_month": _by_time("lineitem", LINEITEM, "l_shipdate", "year-month"), "time_year_month_day": _by_time("events", EVENTS, "ts", "year-month-day"),
    "dict_string_depth1": dict_string_depth1, "dict_string_depth2_lower": dict_string_depth2_lower, "dict_numeric_padded": dict_numeric_padded, "dict_key_lookup": dict_key_lookup,
    "rowlen_bucket": rowlen_bucket, "unique_keep_first": unique_keep_first, "unique_table_scope": unique_table_scope, "unique_greedy": unique_greedy,
    "rolled_file_rows": rolled_file_rows, "topped_up_file_rows": topped_up_file_rows, "sorted_desc_position": sorted_desc_position, "append_two_commits": append_two_commits,
    "ordered_commits": ordered_commits, "empty_scan": empty_scan, "null_audit": null_audit_events, "csv_roundtrip": csv_roundtrip, "ipc_roundtrip": ipc_roundtrip,
    "nested_roundtrip": nested_roundtrip, "builder_frames": builder_frames, "transform_single": transform_single, "transform_partitioned": transform_partitioned, "ohlc_hour": ohlc_hour,
    "schema_sizes": schema_sizes, "join_inner": join_inner, "join_anti": join_anti, "join_asof": join_asof, "agg_rollup": agg_rollup, "window_rank": window_rank, "topk": topk,
    "set_except": set_except, "stream_append": stream_append, "stream_unique": stream_unique, **api_queries.QUERIES,
}

ORACLE_SQL = {
    "mono_roundtrip": "SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderkey // 1000 AS BIGINT) AS bucket FROM orders",
    "mono_bucket_stats": "SELECT CAST(o_orderkey // 1000 AS BIGINT) AS bucket, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1",
    "mono_bucket_prune": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey // 1000 = 0",
    "mono_range_lookup": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 250 AND 1250",
    "time_year": "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders GROUP BY 1",
    "time_month": "SELECT CAST(month(o_orderdate) AS BIGINT) AS month, count(*) AS n FROM orders GROUP BY 1",
    "time_day": "SELECT CAST(day(ts) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY 1",
    "time_year_month": "SELECT CAST(year(l_shipdate) AS BIGINT) AS year, CAST(month(l_shipdate) AS BIGINT) AS month, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "time_year_month_day": "SELECT CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY 1, 2, 3",
    "dict_string_depth1": "SELECT c_custkey, c_mktsegment, substr(c_mktsegment, 1, 1) AS char0 FROM customer",
    "dict_string_depth2_lower": "SELECT substr(lower(p_name), 1, 1) AS char0, substr(lower(p_name), 2, 1) AS char1, count(*) AS n FROM part GROUP BY 1, 2",
    "dict_numeric_padded": "SELECT p_partkey, substr(lpad(CAST(p_partkey AS VARCHAR), 8, '0'), 5, 1) AS char4, substr(lpad(CAST(p_partkey AS VARCHAR), 8, '0'), 6, 1) AS char5 FROM part",
    "dict_key_lookup": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
    "rowlen_bucket": "SELECT CAST((SELECT count(*) FROM part) // 100 AS BIGINT) AS bucket, count(*) AS n FROM part",
    "unique_keep_first": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1",
    "unique_table_scope": "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100",
    "rolled_file_rows": "SELECT bucket, CAST((rn - 1) // 300 AS BIGINT) AS file_no, count(*) AS n FROM (SELECT o_orderkey // 1000 AS bucket, row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1, 2",
    "topped_up_file_rows": "SELECT bucket, CAST((rn - 1) // 300 AS BIGINT) AS file_no, count(*) AS n FROM (SELECT o_orderkey // 1000 AS bucket, row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1, 2",
    "sorted_desc_position": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey DESC) AS pos FROM orders",
    "append_two_commits": "SELECT o_orderkey, o_custkey FROM orders",
    "ordered_commits": "SELECT CAST(f AS BIGINT) AS frame, CAST(sum(n) OVER (ORDER BY f) - n AS BIGINT) AS first_row, n FROM (SELECT o_orderkey % 3 AS f, count(*) AS n FROM orders GROUP BY 1)",
    "empty_scan": "SELECT o_orderkey, CAST(0 AS BIGINT) AS bucket FROM orders WHERE false",
    "null_audit": "SELECT CAST(count(*) FILTER (WHERE ts IS NULL) AS BIGINT) AS null_ts, CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) AS null_value FROM events",
    "csv_roundtrip": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "ipc_roundtrip": "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    "nested_roundtrip": "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS width FROM embeddings",
    "builder_frames": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "transform_single": "SELECT n.n_name, count(*) AS customers FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1",
    "transform_partitioned": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "ohlc_hour": "SELECT date_trunc('hour', ts) AS hour, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close FROM events GROUP BY 1",
    "schema_sizes": "SELECT * FROM (VALUES ('author', 16, 4194304), ('block', 84, 798915), ('market', 40, 1677721), ('pubmed', 148, 453438)) t(name, avg_row_size, row_group_size)",
    "join_inner": "SELECT o.o_orderkey, count(*) AS lines FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1",
    "join_anti": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "join_asof": "SELECT e.event_id, p.event_id AS prev_purchase FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "window_rank": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rnk FROM orders",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "set_except": "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
    "stream_append": "SELECT event_id, user_id, event_type, value FROM events",
    "stream_unique": "SELECT DISTINCT user_id FROM events",
    "unique_greedy": """
WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id || '/' || event_type AS a, event_type || '/' || CAST(floor(value) AS BIGINT) AS b, row_number() OVER (ORDER BY event_id) AS i FROM events),
g(i, event_id, a, b, kept, seen) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), false, CAST([] AS VARCHAR[])
  UNION ALL
  SELECT e.i, e.event_id, e.a, e.b, NOT list_contains(g.seen, 'a' || e.a) AND NOT list_contains(g.seen, 'b' || e.b),
         CASE WHEN list_contains(g.seen, 'a' || e.a) OR list_contains(g.seen, 'b' || e.b) THEN g.seen ELSE list_concat(g.seen, ['a' || e.a, 'b' || e.b]) END
  FROM g JOIN e ON e.i = g.i + 1)
SELECT event_id, a, b FROM g WHERE kept""",
    **api_queries.ORACLE_SQL,
}
