"""The corpus pipeline: documents in, a shuffled training mixture out.

Stages, each over all that the one before it kept: documents that the quality
classifier rejects go; one document of each near-duplicate class stays; passages
that an earlier document has are cut; documents that hold a benchmark item go;
the rest is repeated to equal shares of its sources and shuffled.

Cases: rows without text pass the first stage by the score of an empty text, and the
next three as they are, since nothing says that they are copies or leaks. Rows without
an id are known by their text. Rows that repeat id and text are copies, of which one
stays; rows that share an id only are kept each. Very long texts are read whole by all
stages. An empty table passes as an empty one. Further columns are kept by all stages,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from appendlake.llm import _common, decontaminate, minhash_dedup, mixing, quality_classifier, substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(spark, docs, _common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_one(spark, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_repeats(spark, docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(spark, docs, _common.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replicate(docs)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources", mixture),
]

#: No SQL expresses the trained and the probabilistic stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    scratch = _common.Scratch(spark, "pipeline")
    docs = _common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), str(i))
        if i:
            scratch.drop(str(i - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
