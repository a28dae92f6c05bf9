"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.fs import Files


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


class Scratch:
    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/appendlake-{uuid.uuid4().hex}"
        atexit.register(self._remove)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def _remove(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                Files(self.spark).remove(self.root)
            except Exception:  # noqa: BLE001  the JVM may have gone first at exit
                return
