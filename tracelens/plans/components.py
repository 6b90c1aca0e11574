"""Connected components of an undirected edge table, as tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tracelens.plans.cutting import delete


def components(edges: DataFrame, base: str) -> DataFrame:
    """id, root: the smallest id of its component, for every id of ``edges`` (src, dst) that isn't its own root.

    Stars around the smallest known id grow by turns: every id tells its larger neighbours of the smallest, and then its smaller ones. Only
    minima per id are aggregated, so an id with many neighbours is no single task. Rounds follow the logarithm of a path's length.
    """
    spark = edges.sparkSession
    now = edges.filter("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    state, n = None, 0
    while True:
        seen, path = Observation(), f"{base}/stars={n}"
        marked = now.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("hash"))
        marked.write.parquet(path)
        now = spark.read.schema("src long, dst long").parquet(path)
        if state == seen.get:
            return now.select(F.col("src").alias("id"), F.col("dst").alias("root"))
        state, n = seen.get, n + 1
        if n > 2:
            delete(spark, f"{base}/stars={n - 3}")
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("least")).select("src", F.least("src", "least").alias("least"))
        told = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        least = told.groupBy("src").agg(F.min("dst").alias("least"))
        down = told.join(least, "src")
        now = down.select(F.col("dst").alias("src"), F.col("least").alias("dst")).union(least.select("src", F.col("least").alias("dst"))).filter("src != dst").distinct()
