"""12 Centroid clustering with kd-tree filtering.

The vectors of a partition are put into kd-trees once. A node holds the box of its points, their count and their integer sum.
In each round a tree is filtered from the root: of the centroids that are left, the one nearest to the middle of the box is compared
with each other one at the corner of the box that is best for the other. Where even there the other is strictly farther away, it is
pruned. A node with one centroid left is assigned as a whole, with its count and sum; a leaf that keeps several is resolved exactly.
All arithmetic is on integers, so results don't depend on partitions or order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import cut, discard, table
from tracelens.llm.vectors import integers, over_blocks, packed, unpacked, usable

CLUSTERS, ROUNDS, DIM = 40, 5, 64
#: Vectors of a tree, and of a leaf. A tree is one row of the table of trees, so this bounds what a task holds.
TREE, LEAF = 4096, 16

TREES = "ids binary, points binary, splits binary, boxes binary, sums binary"


def grown(points):
    """(order, splits, boxes, sums): the points' order in which each node is a slice; for each node start, end and the numbers of its
    children (-1 for a leaf); least and greatest components; componentwise sums."""
    import numpy as np

    order, splits, boxes, sums = np.arange(len(points)), [], [], []
    todo = [(0, len(points), -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        some = points[order[lo:hi]]
        least, most = some.min(0), some.max(0)
        me = len(splits)
        splits.append([lo, hi, -1, -1])
        boxes.append((least, most))
        sums.append(some.sum(0))
        if parent >= 0:
            splits[parent][2 + side] = me
        wide = int((most - least).argmax())
        if hi - lo > LEAF and most[wide] > least[wide]:
            middle = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(some[:, wide], middle)]
            todo += [(lo, lo + middle, me, 0), (lo + middle, hi, me, 1)]
    return order, np.array(splits, "<i4"), np.array(boxes, "<i4"), np.array(sums, "<i8")


def tree_rows(blocks: Iterator[dict]) -> Iterator[dict]:
    for b in blocks:
        ids, _, _, points = unpacked(b)
        order, splits, boxes, sums = grown(points)
        yield {"ids": [ids[order].tobytes()], "points": [points[order].astype("<i4").tobytes()], "splits": [splits.tobytes()], "boxes": [boxes.tobytes()], "sums": [sums.tobytes()]}


def dominated(box, c, nearest: int):
    """Which of the centroids ``c`` are strictly farther than ``c[nearest]`` from every point of the box.

    The squared distance to one minus that to the other is linear in the point, so it is least at the corner towards the other."""
    import numpy as np

    away = c - c[nearest]
    corner = np.where(away > 0, box[1], box[0])
    return (away * (c + c[nearest] - 2 * corner)).sum(1) > 0


def filtered(tree: dict, c, whole, leaf) -> None:
    """Walks a tree with the centroids ``c``: ``whole(node, cluster)`` for nodes that go to one, ``leaf(start, end, clusters, nearest)`` with
    a cluster for each point of leaves that had to be resolved."""
    import numpy as np

    splits = np.frombuffer(tree["splits"], "<i4").reshape(-1, 4)
    dim = c.shape[1]
    boxes = np.frombuffer(tree["boxes"], "<i4").reshape(-1, 2, dim).astype(np.int64)
    points = np.frombuffer(tree["points"], "<i4").reshape(-1, dim)
    todo = [(0, np.arange(len(c)))]
    while todo:
        node, left = todo.pop()
        lo, hi, first, second = splits[node]
        box = boxes[node]
        if len(left) > 1:
            few = c[left]
            nearest = int(((2 * few - box.sum(0)) ** 2).sum(1).argmin())
            left = left[~dominated(box, few, nearest)]
        if len(left) == 1:
            whole(node, int(left[0]))
        elif first >= 0:
            todo += [(first, left), (second, left)]
        else:
            some = points[lo:hi].astype(np.int64)
            apart = ((some[:, None, :] - c[left][None, :, :]) ** 2).sum(2)
            leaf(lo, hi, left[apart.argmin(1)])  # of equal ones the first, which is the smaller number


def sums_of(c):
    """A function for ``over_blocks``: count and componentwise sum of each cluster, over the trees of a partition."""

    def run(trees: Iterator[dict]) -> Iterator[dict]:
        import numpy as np

        centres = np.array(c, np.int64)
        for tree in trees:
            count, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
            splits, node_sums = np.frombuffer(tree["splits"], "<i4").reshape(-1, 4), np.frombuffer(tree["sums"], "<i8").reshape(-1, centres.shape[1])
            points = np.frombuffer(tree["points"], "<i4").reshape(-1, centres.shape[1])

            def whole(node, k):
                count[k] += splits[node][1] - splits[node][0]
                total[k] += node_sums[node]

            def leaf(lo, hi, clusters):
                np.add.at(count, clusters, 1)
                np.add.at(total, clusters, points[lo:hi])

            filtered(tree, centres, whole, leaf)
            some = np.flatnonzero(count)
            yield {"cluster": some, "n": count[some], "total": total[some].tolist()}

    return run


def places_of(c):
    """A function for ``over_blocks``: cluster and squared distance of every vector."""

    def run(trees: Iterator[dict]) -> Iterator[dict]:
        import numpy as np

        centres = np.array(c, np.int64)
        for tree in trees:
            splits = np.frombuffer(tree["splits"], "<i4").reshape(-1, 4)
            points = np.frombuffer(tree["points"], "<i4").reshape(-1, centres.shape[1]).astype(np.int64)
            clusters = np.zeros(len(points), np.int64)

            def whole(node, k):
                clusters[splits[node][0] : splits[node][1]] = k

            def leaf(lo, hi, found):
                clusters[lo:hi] = found

            filtered(tree, centres, whole, leaf)
            yield {"vec_id": _ids(tree), "cluster": clusters, "distance": ((points - centres[clusters]) ** 2).sum(1)}

    return run


def _ids(tree: dict) -> list:
    import numpy as np

    ids = np.frombuffer(tree["ids"], "<i8")
    return [None if v == NO_ID else v for v in ids.tolist()]


#: Stands for a null vec_id inside blocks.
NO_ID = -(2**63)


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for rows of (vec_id, embedding).

    Vectors of another dimension or with a null or non-finite component aren't kept. A null vec_id is kept and hashes as an empty text;
    rows of one vec_id hash alike and are started from in the order of their components, equal rows included. Fewer vectors than
    ``clusters`` give as many clusters as there are vectors, an empty table no rows. Further columns don't matter.
    The centroids (``clusters`` x ``dim`` integers) are all that passes through the driver.
    """
    spark = vectors.sparkSession
    kept = vectors.filter(usable("embedding") & (F.size("embedding") == dim))
    kept = cut(kept.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("label"), integers("embedding").alias("v")), "vectors")
    name = F.when(F.col("vec_id") == NO_ID, "").otherwise(F.col("vec_id").cast("string"))
    first = kept.select(F.sha2(F.concat(F.lit("2:"), name).cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(clusters)
    centres = [list(r["v"]) for r in sorted(first.collect(), key=lambda r: (r["h"], r["v"]))]
    if not centres:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = cut(over_blocks(packed(kept, TREE), tree_rows, TREES), "trees")
    for _ in range(rounds):
        found = over_blocks(trees, sums_of(centres), "cluster int, n long, total array<long>")
        each = found.select("cluster", "n", F.posexplode("total").alias("k", "s")).groupBy("cluster", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        for r in each.collect():  # clusters x dim numbers
            centres[r["cluster"]][r["k"]] = int(r["s"]) // r["n"]
    placed = cut(over_blocks(trees, places_of(centres), "vec_id long, cluster int, distance long"), "placed")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    per = placed.groupBy("cluster").agg(exact("distance").alias("s"))
    inertia = {r["cluster"]: int(r["s"]) for r in per.collect()}  # one row a cluster
    rows = [(k, inertia.get(k, 0), sum(inertia.values()), ",".join(map(str, c))) for k, c in enumerate(centres)]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, text string")
    known = known.select("cluster", "cluster_inertia", "inertia", F.sha2(F.col("text").cast("binary"), 256).alias("centroid_sha256"))
    discard(kept, trees)
    return placed.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # one row a cluster


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _sql() -> str:
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT CAST(ROW_NUMBER() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INT) AS cluster, v AS c FROM kept ORDER BY sha256('2:' || vec_id) LIMIT {CLUSTERS})",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, CAST(list_sum(list_transform(range(1, {DIM} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS distance, cluster
  FROM kept, c{r} QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS MATERIALIZED (SELECT cluster, list(m ORDER BY i) AS c FROM (
  SELECT cluster, i, CAST(((SUM(x) - ((SUM(x) % COUNT(*)) + COUNT(*)) % COUNT(*)) / COUNT(*)) AS BIGINT) AS m
   FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, {DIM} + 1)) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster)""")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, COALESCE(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))")
    last = f"a{ROUNDS}"
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, cluster, distance, CAST(SUM(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(SUM(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM {last} JOIN c{ROUNDS} USING (cluster)"""


OP12_SQL = _sql()
