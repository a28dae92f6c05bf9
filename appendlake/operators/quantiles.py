"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch


def exact_quantile(df: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """(key, quantile) for each key with a value, as Spark's percentile gives it (which holds all values of a group in one task).

    Distinct values with their counts are dealt by ranges of (key, value). What earlier ranges
    hold of a key says in which one or two ranges its ranks lie, and only those are ranked.
    """
    scratch = Scratch(df.sparkSession)
    k, v = F.col(key).alias("k"), F.col(value).alias("v")
    counted = df.select(k, v).where("v is not null").groupBy("k", "v").agg(F.count("*").alias("n"))
    ranged = scratch.save(counted.repartitionByRange(F.asc_nulls_first("k"), F.asc("v")).withColumn("part", F.spark_partition_id()), "ranged")
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = ranged.groupBy("k", "part").agg(F.sum("n").alias("n")).select(
        F.col("k").alias("key"), F.col("part").alias("in_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.col("n").alias("held"), ((F.sum("n").over(Window.partitionBy("k")) - 1) * F.lit(p)).alias("at")
    )
    low, high = F.floor("at"), F.ceil("at")
    held = held.where((F.col("before") <= high) & (low < F.col("before") + F.col("held")))
    near = ranged.join(held, F.col("k").eqNullSafe(F.col("key")) & (F.col("part") == F.col("in_part")))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("k", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("upto", upto)
    covers = lambda rank: (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
    found = near.groupBy("k").agg(F.max("at").alias("at"), F.max(F.when(covers(low), F.col("v"))).alias("low"), F.max(F.when(covers(high), F.col("v"))).alias("high"))
    return found.select(F.col("k").alias(key), F.when(low == high, F.col("low")).otherwise(F.col("low") + (F.col("at") - low) * (F.col("high") - F.col("low"))).alias("quantile"))
