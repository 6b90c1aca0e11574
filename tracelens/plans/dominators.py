"""Dominators of a reference graph: what every path from the root to an object runs through.

Starts from a tree of shortest paths, of which an object's dominators are always ancestors. In each round an object's parent becomes the
lowest common ancestor of all that refer to it; when no parent changes, the tree is the dominator tree. Common ancestors are found by binary
lifting for all referrers of an object at once: they are lifted to one depth and then step by step together for as long as
they differ, which takes only the least and the greatest of them, so an object with many referrers is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.plans.cutting import Scratch, cut, work_path


def shortest_paths(edges: DataFrame, root: int, scratch: Scratch) -> DataFrame:
    """id, parent of the ids reachable from ``root``, one round for each step; the root is its own parent."""
    spark = edges.sparkSession
    levels = [scratch.cut(spark.createDataFrame([(root, root)], "id long, parent long"), "level=0")]
    seen = levels[0]
    while True:
        new = edges.join(levels[-1].select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        new = scratch.cut(new.join(seen.select("id"), "id", "left_anti"), f"level={len(levels)}")
        if new.isEmpty():
            return seen
        levels.append(new)
        seen = seen.union(new)


def lifted(tree: DataFrame, root: int, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """([id, up: 2**k steps towards the root] for k = 0, 1, ... until all are at the root, (id, depth))."""
    steps = [scratch.cut(tree.select("id", F.col("parent").alias("up"), (F.col("id") != root).cast("long").alias("n")), f"{name}-up0")]
    while not steps[-1].filter(F.col("up") != root).isEmpty():
        on = steps[-1].select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("n").alias("_n"))
        steps.append(scratch.cut(steps[-1].join(on, "up").select("id", F.col("_up").alias("up"), (F.col("n") + F.col("_n")).alias("n")), f"{name}-up{len(steps)}"))
    return [s.select("id", "up") for s in steps], steps[-1].select("id", F.col("n").alias("depth"))


def common_ancestors(pairs: DataFrame, tree: DataFrame, root: int, scratch: Scratch, name: str) -> DataFrame:
    """id, ancestor: the lowest common ancestor, in a tree of (id, parent), of all ``at`` of an id's ``pairs`` (id, at)."""
    ups, depth = lifted(tree, root, scratch, name)
    moved = lambda p, k: p.join(ups[k].select(F.col("id").alias("at"), "up"), "at")
    placed = scratch.cut(pairs.join(depth.select(F.col("id").alias("at"), "depth"), "at"), f"{name}-placed")
    placed = placed.join(placed.groupBy("id").agg(F.min("depth").alias("to")), "id").select("id", "at", (F.col("depth") - F.col("to")).alias("by"))
    for k in range(len(ups)):
        placed = moved(placed, k).select("id", F.when(F.col("by").bitwiseAND(F.lit(1 << k)) != 0, F.col("up")).otherwise(F.col("at")).alias("at"), "by")
    together = scratch.cut(placed.select("id", "at").distinct(), f"{name}-level")
    for k in reversed(range(len(ups))):
        next_ = scratch.cut(moved(together, k), f"{name}-try{k}")
        apart = next_.groupBy("id").agg((F.min("up") != F.max("up")).alias("apart"))
        together = scratch.cut(next_.join(apart, "id").select("id", F.when(F.col("apart"), F.col("up")).otherwise(F.col("at")).alias("at")).distinct(), f"{name}-at{k}")
    return moved(together, 0).groupBy("id").agg(F.when(F.min("at") == F.max("at"), F.min("at")).otherwise(F.min("up")).alias("ancestor"))


def dominators(edges: DataFrame, root: int) -> DataFrame:
    """id, dominator: the nearest id that is on every path from ``root`` to an id, for all ids that ``edges`` (src, dst) lead to from there.

    Loops, repeated edges and nulls don't matter; an id that nothing leads to has no row, and the root has none either.
    """
    spark = edges.sparkSession
    with Scratch(spark, "dominators") as scratch:
        edges = scratch.cut(edges.filter((F.col("src") != F.col("dst")) & (F.col("dst") != root)).select("src", "dst").distinct(), "edges")
        tree = scratch.cut(shortest_paths(edges, root, scratch), "tree")
        pairs = edges.join(tree.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("at"))
        # one referrer is the dominator; only ids with several can change
        several = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
        pairs, n = scratch.cut(pairs.join(several, "id", "left_semi"), "pairs"), 0
        while True:
            found = scratch.cut(common_ancestors(pairs, tree, root, scratch, f"round{n}"), f"found{n}")
            if found.join(tree, "id").filter("ancestor != parent").isEmpty():
                return cut(tree.filter(F.col("id") != root).select("id", F.col("parent").alias("dominator")), work_path(spark, "dominators"))
            tree, n = scratch.cut(tree.join(found, "id", "left").select("id", F.coalesce("ancestor", "parent").alias("parent")), f"tree{n}"), n + 1


#: Stands for all that holds objects without being one.
ROOT = 0


def heap_dominators(refs: DataFrame) -> DataFrame:
    """Dominators along field references, from a root that holds class representatives and whatever a variable has held."""
    held = refs.filter("kind = 'var'").select(F.col("callee").alias("dst")).union(refs.filter("caller < 0").select("caller"))
    fields = refs.filter("kind = 'field'").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return dominators(held.distinct().select(F.lit(ROOT).cast("long").alias("src"), "dst").union(fields), ROOT)
