"""Declared columns of the tables that queries are registered for, and ways to store them."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import types as L
from .operators.scratch import Scratch
from .plans.partitioning import Partition
from .table import Table
from .types import TypeHints

ORDERS = [
    ("o_orderkey", L.Mono(4), TypeHints(sort="asc")), ("o_custkey", L.Int64), ("o_orderstatus", L.Keyword, TypeHints(avg_str_size=1)), ("o_totalprice", L.Float64),
    ("o_orderdate", L.Datetime()), ("o_orderpriority", L.Keyword, TypeHints(avg_str_size=8)),
]
LINEITEM = [("l_orderkey", L.Mono(4)), ("l_linenumber", L.Int32), ("l_returnflag", L.Keyword), ("l_linestatus", L.Keyword), ("l_shipdate", L.Datetime())]
EVENTS = [
    ("event_id", L.Mono(4), TypeHints(sort="asc")), ("ts", L.Datetime()), ("user_id", L.Int64), ("event_type", L.Keyword, TypeHints(avg_str_size=8)), ("value", L.Float64),
    ("props", L.String, TypeHints(avg_str_size=32, optional=True)),
]
CUSTOMER = [("c_custkey", L.Int64), ("c_name", L.String, TypeHints(avg_str_size=18)), ("c_nationkey", L.Int32), ("c_mktsegment", L.Keyword, TypeHints(avg_str_size=10))]
PART = [("p_partkey", L.Int64, TypeHints(sort="asc")), ("p_name", L.String, TypeHints(avg_str_size=20))]
SUPPLIER = [("s_suppkey", L.Int64, TypeHints(sort="asc")), ("s_name", L.String, TypeHints(avg_str_size=18)), ("s_nationkey", L.Int32)]
NATION = [("n_nationkey", L.Int32, TypeHints(sort="asc")), ("n_name", L.String, TypeHints(avg_str_size=8)), ("n_regionkey", L.Int32)]
EMBEDDINGS = [("vec_id", L.Int64, TypeHints(sort="asc")), ("embedding", L.List(L.Float32), TypeHints(avg_list_size=64)), ("label", L.Int32)]


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_table(spark: SparkSession, name: str, columns: Any, by: Partition | None = None, **more: Any) -> Table:
    """A table of its own folder in the shared scratch folder."""
    return Table(spark, name, f"{Scratch(spark).root}/{name}-{uuid.uuid4().hex[:8]}", columns, partitioning=by, **more)


def stored(spark: SparkSession, sf_dir: str, name: str, columns: Any, by: Partition | None = None, df: DataFrame | None = None, **more: Any) -> Table:
    """A driver table, committed and ready to scan."""
    t = new_table(spark, name, columns, by, **more)
    t.append(source(spark, sf_dir, name) if df is None else df)
    return t


FIXTURES = {
    "author": [("name", L.Keyword), ("pmid", L.Mono(8), TypeHints(sort="asc"))],
    "block": [("number", L.Mono(4), TypeHints(sort="asc")), ("timestamp", L.Datetime("us", "UTC")), ("hash", L.Keyword, TypeHints(avg_str_size=64))],
    "market": [("time", L.Datetime("ms", "UTC")), *((n, L.Float64) for n in ("open", "high", "low", "close"))],
    "pubmed": [("pmid", L.Mono(8), TypeHints(sort="asc")), ("pub_date", L.Date), ("title", L.String, TypeHints(avg_str_size=128))],
}
