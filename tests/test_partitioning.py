import datetime as dt
import warnings
from decimal import Decimal

import pytest

from appendlake import DictionaryPartition, MonoPartition, RowLenPartition, Schema, TimePartition
from appendlake import types as L
from appendlake.errors import AppendlakeWarning, TableLayoutError
from appendlake.plans.partitioning import Partition


def _keys(spark, schema, spec, rows, kind):
    df = spark.createDataFrame([(r,) for r in rows], kind)
    made = spec.keys(schema)
    return [tuple(r) for r in df.select(*(c.alias(k) for k, c in made.items())).collect()]


def test_mono_is_exact(spark):
    s = Schema([("n", L.Mono(8))])
    got = _keys(spark, s, MonoPartition("n", 1000), [Decimal(n) for n in (0, 999, 1000, 2**53 + 1, 2**63)], "n decimal(20,0)")
    assert [g[0] for g in got] == [0, 0, 1, (2**53 + 1) // 1000, 2**63 // 1000]
    s = Schema([("n", L.Mono(4))])
    assert _keys(spark, s, MonoPartition("n", 10), [-1, -10, 9], "n bigint") == [(-1,), (-1,), (0,)]
    with pytest.raises(TableLayoutError):
        MonoPartition().check(Schema([("n", L.Int64)]))


def test_time(spark):
    s = Schema([("t", L.Date)])
    for kind, want in (("year", (2024,)), ("month", (2,)), ("day", (29,)), ("year_month", (2024, 2)), ("year-month-day", (2024, 2, 29))):
        assert _keys(spark, s, TimePartition("t", kind), [dt.date(2024, 2, 29)], "t date") == [want]
    with pytest.raises(ValueError):
        TimePartition("t", "week").check(s)
    with pytest.raises(TableLayoutError):
        TimePartition("n").check(Schema([("n", L.Int64)]))


def test_dictionary(spark):
    s = Schema([("k", L.Keyword)])
    assert _keys(spark, s, DictionaryPartition("k", 2, lowercase=True), ["Al", "B", "", None], "k string") == [("a", "l"), ("b", ""), ("", ""), (None, None)]
    s = Schema([("c", L.Int64)])
    p = DictionaryPartition("c", 2, pad_to=4)
    assert _keys(spark, s, p, [7, 42, 105, 1002, -42, 123456], "c bigint") == [("0", "0"), ("0", "0"), ("0", "1"), ("1", "0"), ("0", "0"), ("1", "2")]
    assert _keys(spark, s, DictionaryPartition("c", 3, pad_to=4, signed=True), [-42, 42], "c bigint") == [("-", "0", "4"), ("0", "0", "4")]
    with pytest.warns(AppendlakeWarning):
        DictionaryPartition("c").check(s)
    with pytest.raises(TableLayoutError):
        DictionaryPartition("x").check(Schema([("x", L.List(L.Int8))]))


def test_specs_in_general(spark):
    s = Schema([("bucket", L.Mono(4))])
    with pytest.raises(TableLayoutError):
        MonoPartition().check(s)
    with pytest.raises(ValueError):
        MonoPartition("none").check(Schema([("n", L.Mono(4))]))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for spec in (RowLenPartition("a", 5), MonoPartition(1, 7), TimePartition("t", "day"), DictionaryPartition("k", 2, 3, True, True)):
            assert Partition.decode(spec.encode()) == spec
    rows = spark.range(1).select(*(c.alias(k) for k, c in RowLenPartition(row_size=100).keys(s, 250).items())).first()
    assert rows[0] == 2


def test_implied_keys():
    mono = Schema([("n", L.Mono(4))])
    text = Schema([("k", L.Keyword)])
    assert "(bucket, 3)" in str(MonoPartition("n", 10).implied(mono, "=", 35)) and "<=" in str(MonoPartition("n", 10).implied(mono, "<", 35))
    d = DictionaryPartition("k", 3, lowercase=True)
    assert "char2" not in str(d.implied(text, "=", "AB")) and "char1" in str(d.implied(text, "prefix", "AB"))
    assert d.implied(text, "=", "") is None and d.implied(text, "<", "a") is None
    t = Schema([("t", L.Datetime())])
    assert TimePartition("t", "month").implied(t, "<", dt.datetime(2024, 1, 1)) is None
    assert "year" in str(TimePartition("t", "year-month").implied(t, ">=", dt.datetime(2024, 1, 1)))
    assert RowLenPartition().implied(text, "=", "a") is None
