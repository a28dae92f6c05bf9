import datetime as dt
import json

import pytest
from pyspark.sql import types as T

from appendlake import queries as Q
from appendlake import types as L
from appendlake.operators.dedupe import Greedy, bloom_params
from appendlake.schema import Column, Schema
from appendlake.types import TypeHints


@pytest.mark.parametrize(("name", "row", "group"), [("author", 16, 4_194_304), ("block", 84, 798_915), ("market", 40, 1_677_721), ("pubmed", 148, 453_438)])
def test_sizes(name, row, group):
    s = Schema(Q.FIXTURES[name])
    assert (s.avg_row_size, s.row_group_size) == (row, group)


def test_nested_sizes_and_kinds():
    assert L.avg_size(L.List(L.Float32), TypeHints(avg_list_size=10)) == 48
    assert L.avg_size(L.Struct(a=L.Int32, b=L.Keyword), TypeHints(avg_str_size=4)) == 8 + 4 + 12
    assert L.avg_size(L.List(L.String), TypeHints(avg_list_size=3, nested=TypeHints(avg_str_size=5))) == 8 + 3 * 13
    assert [L.kind(t) for t in (L.Boolean, L.Keyword, L.Mono(4), L.Array(L.Int8, 3))] == ["numeric", "string", "numeric", "nested"]
    with pytest.raises(TypeError):
        L.LogicalType("map")
    with pytest.raises(ValueError):
        L.Mono(3)


def test_spark_types_and_round_trip():
    s = Schema([("a", L.Mono(4), TypeHints(sort="desc", unique=True)), ("b", L.Array(L.Decimal(5, 2), 3)), {"name": "c", "type": "keyword", "hints": {"optional": True}}, Column("d", L.Struct(x=L.Datetime("us", "UTC")))])
    assert Schema.from_json(s.to_json()) == s == Schema.of(s.to_spark()) == Schema.of(s.encode())
    struct = s.to_spark()
    assert struct["a"].dataType == T.LongType() and not struct["a"].nullable and struct["c"].nullable
    assert L.Mono(8).to_spark() == T.DecimalType(20, 0) and L.Mono(8).to_spark(narrow_u64=True) == T.LongType()
    assert s.columns[1].type.width == 3
    assert "sort desc" in s.pretty_str() and "optional" in s.pretty_str()
    assert [c.name for c in s.nested_columns] == ["b", "d"] and [c.name for c in s.string_columns] == ["c"]
    with pytest.raises(ValueError):
        Schema([("a", L.Int8), ("a", L.Int8)])
    with pytest.raises(ValueError):
        Schema([("a", L.Int8)], target_group_size=0)


def test_python_types():
    assert L.python_type(L.List(L.Int8)) == list[int]
    assert L.python_type(L.String, TypeHints(optional=True)) == str | None
    row = Schema([("a", L.Int8), ("b", L.String, TypeHints(optional=True))]).row_class("my_table")
    assert row(a=1).b is None and row.__name__ == "MyTableRow"


def test_json_keeps_times():
    assert json.loads(L.dumps({"t": dt.datetime(2024, 1, 2, 3, 4), "d": dt.date(2024, 1, 2), "s": {2, 1}})) == {"t": "2024-01-02T03:04:00", "d": "2024-01-02", "s": [1, 2]}


def test_bloom_params():
    assert bloom_params(30_000_000, 0.001) == (431_327_627, 10)
    for bad in ((0, 0.1), (1, 0), (1, 1)):
        with pytest.raises(ValueError):
            bloom_params(*bad)



def test_greedy_counts_accepted_rows_only():
    g = Greedy([0, 1])
    assert [g.accept(r) for r in [("a", 1), ("a", 2), ("b", 2), (None, 3), (None, 4)]] == [True, False, True, True, True]
