"""Mixing sources to target weights by Poisson replication.

Each source has a size (code points of its texts) and a target share; its mean
repetition rate is share * total / size. A document is repeated a Poisson number
of times with that mean, found by inverting the distribution at a uniform number
hashed from (seed, doc_id), so that a recomputed task makes the same copies. The
documents are exploded by their counts and put in a global order by a hash of
(seed, doc_id, copy). That hash is uniform, so its ranges, by which the rows are dealt,
are known beforehand: nothing is run twice to sample them.

Cases: null sources are one source of their own. A source without a target
share, or with a rate of 0, gives no copies. A null text has size 0 and is repeated
like any other, as are very long ones, whole; if all texts of a source are empty, its
rate is 0. A null doc_id hashes as the text 'null'. Rows that repeat a doc_id draw the
same count, and their copies tie in the order. Rates of any size are whole: sums of
Poisson numbers of mean STEP at most. An empty table gives an empty one. Other columns
are kept; where copy or shuffle_key are among them, the new columns get a further _.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

SEED = 20_240
#: A rate beyond STEP is drawn as a sum of Poisson numbers of equal, smaller means.
STEP = 8.0
TERMS = 64  # P(Poisson(8) >= 64) is below 1e-30


def unit(*parts: str) -> str:
    """SQL for a number in [0, 1) from the first 12 hex digits of an MD5."""
    return f"cast(conv(substring(md5(concat_ws('/', {', '.join(parts)})), 1, 12), 16, 10) as bigint) / 281474976710656D"


def rates(docs: DataFrame, weights: DataFrame | None) -> DataFrame:
    """(source, rate) by the shares in weights(source, weight); without weights all sources get equal shares."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0))).alias("size"))
    if weights is None:
        shares = sizes.select("source", "size", F.lit(1.0).alias("weight"))
    else:
        w = weights.groupBy("source").agg(F.sum("weight").alias("weight")).withColumnRenamed("source", "s")
        shares = sizes.join(w, sizes["source"].eqNullSafe(F.col("s"))).drop("s")
    totals = shares.where("weight > 0 and size > 0").agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    return shares.join(F.broadcast(totals)).select("source", F.when((F.col("size") > 0) & (F.col("weight") > 0), F.col("weight") / F.col("all_weight") * F.col("all_size") / F.col("size")).otherwise(0.0).alias("rate"))


def _count(rate: str, seed: int) -> F.Column:
    """The Poisson number at the hashed uniform: how many cumulative probabilities it is not below."""
    parts = f"cast(greatest(1, ceil({rate} / {STEP}D)) as int)"
    mean = f"({rate} / {parts})"
    draw = unit(f"'{seed}'", "coalesce(cast(doc_id as string), 'null')", "cast(i as string)")
    # acc: the draw, made once; mean; probability of k, cumulative probability, k so far. The loop is over a constant number of terms.
    one = (
        f"aggregate(sequence(1, {TERMS}), named_struct('u', {draw}, 'm', {mean}, 'p', exp(-{mean}), 'c', exp(-{mean}), 'n', 0), "
        f"(acc, k) -> if(acc.c > acc.u, acc, named_struct('u', acc.u, 'm', acc.m, 'p', acc.p * acc.m / k, 'c', acc.c + acc.p * acc.m / k, 'n', acc.n + 1)), acc -> acc.n)"
    )
    return F.expr(f"aggregate(sequence(1, {parts}), 0, (a, i) -> a + {one})")


def replicate(docs: DataFrame, weights: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """docs' columns, copy (1 to the count) and shuffle_key, in the order of shuffle_key."""
    spark, taken = docs.sparkSession, docs.columns
    source, rate_, n = (C.spare(taken, c) for c in ("source", "rate", "n"))
    copy, order = (c if c not in map(str.lower, taken) else C.spare(taken, c) for c in ("copy", "shuffle_key"))
    rate = C.Scratch(spark, "mixing").save(rates(docs, weights).select(F.col("source").alias(source), F.col("rate").alias(rate_)), "rates")
    # One source may hold a third of all rows; the rates are joined by broadcast where they are few, else Spark splits the skewed side.
    few = rate.count() <= C.FEW
    joined = docs.join(F.broadcast(rate) if few else rate, docs["source"].eqNullSafe(rate[source])).where(F.col(rate_) > 0)
    counted = joined.withColumn(n, _count(f"`{rate_}`", seed)).where(F.col(n) > 0).drop(source, rate_)
    copies = counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n)
    copies = copies.withColumn(order, F.expr(f"md5(concat_ws('/', '{seed + 1}', coalesce(cast(doc_id as string), 'null'), cast(`{copy}` as string)))"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * parts / 2**32
    return copies.repartitionById(parts, F.floor(place).cast("int")).sortWithinPartitions(order)


def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents mixed to equal shares of the sources: doc_id, source, text, copy, shuffle_key."""
    docs = C.table(spark, sf_dir, "documents")
    return replicate(docs.select("doc_id", "source", "text"))


OP7_SQL = f"""
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY 1),
totals AS (SELECT sum(size) AS all_size, count(*) AS all_weight FROM sizes WHERE size > 0),
rates AS (SELECT source, CASE WHEN size > 0 THEN CAST(1.0 AS DOUBLE) / all_weight * all_size / size ELSE 0.0 END AS rate FROM sizes, totals),
d AS (SELECT doc_id, documents.source, text, rate, CAST(greatest(1, ceil(rate / {STEP})) AS INTEGER) AS parts
      FROM documents JOIN rates ON documents.source IS NOT DISTINCT FROM rates.source WHERE rate > 0),
draws AS (SELECT doc_id, source, text, rate / parts AS mean, i,
          CAST(('0x' || substr(md5('{SEED}/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || i), 1, 12)) AS BIGINT) / CAST(281474976710656 AS DOUBLE) AS u,
          row_number() OVER () AS r FROM d, unnest(range(1, parts + 1)) t(i)),
terms AS (SELECT r, k, CASE WHEN k = 0 THEN exp(-mean) ELSE exp(-mean + k * ln(mean) - lgamma(k + 1)) END AS p FROM draws, unnest(range(0, {TERMS})) t(k)),
cdf AS (SELECT r, k, sum(p) OVER (PARTITION BY r ORDER BY k) AS c FROM terms),
counted AS (SELECT doc_id, source, any_value(text) AS text, count(*) FILTER (WHERE c <= u) AS n FROM draws JOIN cdf USING (r) GROUP BY doc_id, source)
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS copy, md5('{SEED + 1}/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || copy) AS shuffle_key
FROM counted, unnest(range(1, n + 1)) t(copy)
"""
