import random

from pyspark.sql import functions as F

from appendlake import api_queries as A
from appendlake.operators.quantiles import exact_quantile


def _plans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _tables(spark, tmp_path, name, df):
    df.write.parquet(f"{tmp_path}/sf/{name}.parquet")
    return f"{tmp_path}/sf"


def test_exact_quantile_is_percentile(spark):
    draw = random.Random(5)
    rows = [(k, draw.choice([None, draw.randrange(9), draw.random() * 100])) for k in (None, "a", "b", "c") for _ in range({None: 101, "a": 500, "b": 2, "c": 1}[k])] + [("none", None)]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "k string, v double").repartition(3)
    for p in (0.0, 0.5, 0.9, 1.0):
        want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", F.lit(p)).alias("q")).collect() if r.q is not None}
        got = {r.k: r.quantile for r in exact_quantile(df, "k", "v", p).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), p


def test_approx_keeps_no_group_in_one_task(spark, tmp_path):
    """no exact percentile of a whole group, and no summaries by distinct value; groups of null and without values keep their rows."""
    rows = [(i, i % 7, ["F", "O", None][i % 3], float(i) if i % 3 else None, None, "1") for i in range(300)]
    df = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    out = A.agg_approx(spark, _tables(spark, tmp_path, "orders", df))
    assert {r.o_orderstatus: (r.distinct_near, r.median_near) for r in out.collect()} == {"F": (True, None), "O": (True, True), None: (True, True)}
    assert " percentile(" not in _plans(out)
    assert not any("percentile_approx" in line and "o_custkey#" in line.partition("functions=")[0] for line in _plans(out).splitlines() if "HashAggregate(" in line)


def test_cube_equals_sparks_own(spark, tmp_path):
    """distinct orders without four rows a line; nulls in keys and orders count as in SQL."""
    draw = random.Random(3)
    rows = [(draw.choice([None, *range(40)]), i, draw.choice(["A", "N", "R", None]), draw.choice(["F", "O"]), "1995-03-04") for i in range(600)]
    df = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_returnflag string, l_linestatus string, d string").withColumn("l_shipdate", F.col("d").cast("timestamp_ntz")).drop("d")
    out = A.agg_cube(spark, _tables(spark, tmp_path, "lineitem", df))
    want = df.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"))
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    expand = _plans(out).partition("Expand")[2]
    assert "row_number" in expand and "l_orderkey" not in expand.partition("HashAggregate")[0]
