"""Resumable stages: computed once per settings, read afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a complete table lies at ``path``."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def stage(spark: SparkSession, folder: str, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a stage: read if complete for these settings, else made and written. Lineage ends here."""
    path = f"{folder}/{name}-{key}"
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
