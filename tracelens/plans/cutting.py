"""Lineage cuts for iterative plans: tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the cluster names in ``spark.checkpoint.dir``. On one machine alone a temporary folder
    will do; on a cluster nothing is guessed."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/tracelens/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    """Deletes written folders in whatever store they are; for tables that nothing will read again."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables that are needed for as long as a ``with`` block runs."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, work_path(spark, name)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        return cut(df, f"{self.base}/{name}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.base)
