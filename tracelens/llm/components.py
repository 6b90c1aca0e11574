"""Connected components of an edge table, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import cut, discard, sized


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Links every v of a u to the smallest node at u. Hot nodes: minima are pre-aggregated and the join
    can be split, so no task has to hold a node's neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter(F.col("u") != F.col("v"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``edges`` (u, v; any order, repeats and
    loops allowed, no nulls). Alternates large-star and small-star steps until the edges are stars; each round is
    written to the shared folder and the one before goes. The number of rounds grows with the logarithm of the longest path squared at worst."""
    now = cut(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        pairs = _both(now)
        large = _star(pairs, pairs.filter(F.col("v") > F.col("u")))
        # small-star: all edges point from the larger node to the smaller
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        links = down.join(least, "u")
        small = links.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, now = now, cut(small.filter("u != v").distinct(), "edges")
        discard(before)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == state:
            break
        state = (seen["n"], seen["h"])
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Nodes of a bucket that all its others are compared to first, or by whose likeness the one in the middle is found.
LEADERS = 8


def crowd(member: DataFrame) -> DataFrame:
    """The rows of ``member`` (bucket, node and more) whose bucket has another node. Buckets are counted with
    map-side sums, and only those that are shared are joined back."""
    shared = cut(member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "shared")
    return cut(member.join(sized(shared, 24), "bucket"), "crowded")


def led(crowded: DataFrame, verify, near, alike=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first part of ``linked``: the pairs (u, v) of a bucket's nodes with its leaders, the links among them, and node, root."""
    own = F.struct(*[c for c in crowded.columns if c != "bucket"])
    ranks = [F.xxhash64("node", F.lit(k)) for k in range(LEADERS)]
    least = crowded.groupBy("bucket").agg(*[F.min(r).alias(f"_l{k}") for k, r in enumerate(ranks)])
    leads = F.lit(False)
    for k, r in enumerate(ranks):
        leads = leads | (F.col(f"_l{k}") == r)
    leader = crowded.join(least, "bucket").filter(leads).select(F.col("bucket").alias("_b"), own.alias("lead"))
    if alike:
        few = leader.groupBy("_b").agg(F.collect_list("lead").alias("few"))
        score = F.aggregate("few", F.lit(0), lambda n, x: n + alike(x, F.col("_own")))
        scored = crowded.select("bucket", own.alias("_own")).join(few, F.col("_b") == F.col("bucket")).select("bucket", "_own", score.alias("score"))
        leader = scored.groupBy("bucket").agg(F.max(F.struct("score", "_own")).alias("top")).select(F.col("bucket").alias("_b"), F.col("top._own").alias("lead"))
    stars = crowded.join(leader, (F.col("_b") == F.col("bucket")) & (F.col("node") != F.col("lead.node")) & near(F.col("lead"), own))
    stars = cut(stars.select(F.least("lead.node", "node").alias("u"), F.greatest("lead.node", "node").alias("v")).distinct(), "stars")
    edges = cut(verify(stars), "links")
    return stars, edges, components(edges)


def linked(crowded: DataFrame, verify, near, once=None) -> DataFrame:
    """node, root for the nodes that are linked: candidates share a bucket and ``verify`` keeps the pair.

    ``crowded``: bucket, node and the further columns that ``near`` looks at, of the buckets with several nodes; a table that was
    cut. ``near(u, v)``, given two structs of node and these, is a cheap condition that every link fulfils.
    ``once(u, v, bucket)`` picks one of the buckets that two nodes share. ``verify`` maps (u, v) rows to those that are links.
    First every node of a bucket is compared to ``LEADERS`` nodes picked by hash, which joins nearly all that belong together (``led``; if
    ``alike(u, v)`` says how much two nodes have in common, it is compared there to the one node that is most like these: copies of
    one text are all nearer to it than to each other).
    Then, of a bucket whose nodes are still in different components, the pairs across components are looked at, each with a
    node outside the bucket's largest component; those that are near are verified. So every pair that could join two components is
    decided, but a group of many copies costs a few comparisons a copy.
    """
    stars, edges, roots = led(crowded, verify, near)
    own = F.struct(*[c for c in crowded.columns if c != "bucket"])
    placed = crowded.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = cut(placed.groupBy("bucket", "root").agg(F.count("*").alias("n")), "sizes")
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).filter("roots > 1")
    main = cut(main.select("bucket", F.col("top.root").alias("main")), "main")
    split = placed.join(sized(main, 40), "bucket").select("bucket", "root", "main", own.alias("own"))
    split = cut(split, "split")
    x, y = split.filter("root != main").alias("x"), split.alias("y")
    ahead = (F.col("y.root") == F.col("y.main")) | (F.col("x.own.node") < F.col("y.own.node"))
    on = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") != F.col("y.root")) & ahead & near(F.col("x.own"), F.col("y.own"))
    cross = x.join(y, on & once(F.col("x.own"), F.col("y.own"), F.col("x.bucket")) if once else on)
    cross = cross.select(F.least("x.own.node", "y.own.node").alias("u"), F.greatest("x.own.node", "y.own.node").alias("v")).distinct()
    cross = cut(cross.join(stars, ["u", "v"], "left_anti"), "cross")
    discard(stars, split, sizes, main)
    more = cut(verify(cross), "links")
    return roots if more.isEmpty() else components(edges.union(more))
