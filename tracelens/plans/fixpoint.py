"""Reachability as a semi-naive fixpoint.

Each round joins only the newly found ids to the edges that still lead to ids not seen, and writes what it finds. Every few
rounds the edges to seen ids are dropped, so a round compares with the ids found since then and not with all of them. A closure
that is still running then has long paths: first ids that refer to each other, as in doubly linked lists, become one; then paths get
shortcuts, so that the number of rounds follows the logarithm of a path and not its length. What was written on the way is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tracelens.plans.components import components
from tracelens.plans.cutting import cut, delete, work_path

#: Rounds between two prunings of the edges.
PRUNE = 8
#: Prunings before shortcuts are made, and doublings of their first making; each later one adds as many.
PATIENCE, DOUBLINGS = 2, 8


def counted(df: DataFrame, path: str) -> int:
    """Writes ``df`` and returns its number of rows, in one job."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get["n"]


def shortcuts(edges: DataFrame, doublings: int, path: str) -> DataFrame:
    """``edges`` and, of every id, edges to the ids 2, 4, ... steps on along one choice of successor: the largest, and the smallest.

    Each leads to an id that can be reached anyway, so closures don't change. Successors from which nothing leads on are no choice.
    Ids are given in the order of allocation, so lists, also doubly linked ones, mostly run along one of the two choices; singly linked ones always do.
    At most two edges for every id and doubling are added.
    """
    onward = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").filter("src != dst")
    ends = onward.groupBy("src").agg(F.max("dst").alias("up"), F.min("dst").alias("down"))
    ways = ends.select("src", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("up").alias("dst")), F.struct(F.lit(1).alias("way"), F.col("down").alias("dst")))).alias("w"))
    step, levels = cut(ways.select("src", "w.way", "w.dst"), f"{path}/step=0"), []
    for k in range(1, doublings + 1):
        on = step.select(F.col("src").alias("dst"), "way", F.col("dst").alias("next"))
        twice = step.join(on, ["dst", "way"]).filter("src != next").select("src", "way", F.col("next").alias("dst"))
        if not counted(twice, f"{path}/step={k}"):
            break
        step = edges.sparkSession.read.schema(twice.schema).parquet(f"{path}/step={k}")
        levels.append(step)
    out = edges
    for level in levels:
        out = out.union(level.select("src", "dst"))
    return out


def contracted(edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(edges between contracted ids, (id, root) of the ids that were merged into others), or None if nothing can be. Ids that refer to each
    other reach the same ids, and so do ids that are connected by such pairs, in whatever order they lie."""
    mutual = edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").filter("src < dst")
    if not counted(mutual, f"{path}/mutual"):
        return None
    roots = components(edges.sparkSession.read.schema("src long, dst long").parquet(f"{path}/mutual"), path)
    for end in ("src", "dst"):
        edges = edges.join(roots.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    return cut(edges.filter("src != dst").distinct().select("src", "dst"), f"{path}/contracted"), roots


def reach(edges: DataFrame, seeds: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """ids reachable from ``seeds`` (id) along ``edges`` (src, dst), seeds included. Nulls lead nowhere; an empty table of either
    kind gives the seeds."""
    return closed(edges.select("src", "dst"), seeds.select(F.col("id").cast("long").alias("id")), work_path(seeds.sparkSession, "reach"), max_rounds, True)


def closed(edges: DataFrame, seeds: DataFrame, base: str, max_rounds: int, contract: bool) -> DataFrame:
    """``reach`` within the folder ``base``, of which the rounds stay."""
    spark = seeds.sparkSession
    files = lambda *rounds: spark.read.schema("id long").parquet(*[f"{base}/round={r}" for r in rounds])
    found = counted(seeds.distinct(), f"{base}/round=0")
    left, since, used = edges, 0, []
    for n in range(1, max_rounds + 1):
        if not found:
            delete(spark, *used)
            return files(*range(n))
        if n % PRUNE == 0:
            left = cut(left.join(files(*range(since, n)), F.col("dst") == F.col("id"), "left_anti"), f"{base}/left={n}")
            delete(spark, *used)
            since, age, used = n, n // PRUNE, [f"{base}/left={n}"]
            if age >= PATIENCE and contract:
                contract = False
                if small := contracted(left, f"{base}/merged"):
                    # from here on with merged ids: what was found last leads on, all else was followed before
                    merged, roots = small
                    last = files(n - 1).join(roots, "id", "left").select(F.coalesce("root", "id").alias("id"))
                    more = closed(merged, last, f"{base}/of-merged", max_rounds, False)
                    members = roots.join(more.withColumnRenamed("id", "root"), "root", "left_semi").select("id")
                    new = more.union(members).join(files(*range(n)), "id", "left_anti")
                    counted(new.distinct(), f"{base}/round={n}")
                    delete(spark, *used, f"{base}/merged", f"{base}/of-merged")
                    return files(*range(n + 1))
            if age >= PATIENCE and age % PATIENCE == 0:
                left = shortcuts(left, DOUBLINGS * age // PATIENCE, f"{base}/jumps={n}")
                left = cut(left.distinct(), f"{base}/short={n}")
                delete(spark, f"{base}/jumps={n}")
                used.append(f"{base}/short={n}")
        new = left.join(files(n - 1), F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct()
        if since < n:
            new = new.join(files(*range(since, n)), "id", "left_anti")
        found = counted(new.filter("id is not null"), f"{base}/round={n}")
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
