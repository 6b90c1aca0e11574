"""11 Hard-negative mining by bit-sliced integer products.

Vectors are integers in two's complement. A block of rows is cut into bit-planes; a block of anchors is multiplied with one plane
at a time, the most significant first. After each plane the score of a pair lies in a known interval, since what is left of a component
is between 0 and 2**j - 1. Pairs whose interval can't qualify any more are dropped, and the planes that follow are multiplied for
the pairs that are left only.

Anchors are the query set: they meet all rows in blocks, and what a task keeps of each anchor is a few rows. The best lists of the
blocks that a task has seen raise the bounds for those that follow.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelens.llm.common import cut, discard, table
from tracelens.llm.vectors import BLOCK, integers, over_blocks, packed, unpacked, usable

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is from LOW to HIGH hundredths of the positive's.
LOW, HIGH = 30, 90
#: Vectors in a block of rows, and of anchors.
ROWS, ANCHORS = 2048, 256
#: Blocks of anchors that are broadcast for one pass over the rows; their vectors and best lists are what a task holds.
PASS = 64
#: Share of live pairs from which a plane is multiplied as a whole.
DENSE = 0.2


def planes(points) -> Iterator[tuple[int, object]]:
    """(weight, bits) of integers in two's complement, the most significant plane first."""
    import numpy as np

    top = int(max(points.max(initial=0), -1 - points.min(initial=0))).bit_length()
    for j in range(top, -1, -1):
        yield -(1 << j) if j == top else 1 << j, ((points >> j) & 1).astype(np.float64)


def sliced(anchors, points, alive, qualifies):
    """(anchor, row, score) arrays of the pairs that are left after all planes.

    ``alive``: (anchors x rows) pairs to look at. ``qualifies(low, high, alive)`` says which of them can still qualify, given bounds of
    their scores; after the last plane both bounds are the score.
    """
    import numpy as np

    a = anchors.astype(np.float64)  # products of a plane are sums of integers below 2**53
    up, down = np.maximum(anchors, 0).sum(1)[:, None], np.minimum(anchors, 0).sum(1)[:, None]
    score = np.zeros(alive.shape, np.int64)
    for weight, bits in planes(points):
        if alive.mean() > DENSE:
            score += weight * np.rint(a @ bits.T).astype(np.int64)
        else:
            for i in np.flatnonzero(alive.any(1)):
                some = np.flatnonzero(alive[i])
                score[i, some] += weight * np.rint(bits[some] @ a[i]).astype(np.int64)
        left = abs(weight) - 1
        alive = alive & qualifies(score + left * down, score + left * up, alive)
    at = np.nonzero(alive)
    return *at, score[at]


def kth(values, among, k: int):
    """The k-th largest value of each row among those marked, or the least number there is if fewer are marked."""
    import numpy as np

    none = np.iinfo(np.int64).min
    if values.shape[1] < k:
        return np.full((len(values), 1), none)
    return np.partition(np.where(among, values, none), values.shape[1] - k, axis=1)[:, -k][:, None]


def best(ids, rows, scores, k: int):
    """Places of the first k: higher scores first, then smaller ids, then earlier rows."""
    import numpy as np

    return np.lexsort((rows, ids, -scores))[:k]


def _meeting(blocks: DataFrame, anchors: DataFrame, parts: list[int]) -> DataFrame:
    """Each block of rows beside each of the anchor blocks ``parts``, which are broadcast: at most ``PASS`` blocks of ``ANCHORS`` vectors."""
    few = anchors.filter(F.col("part").isin(parts)).select("part", F.struct(*[c for c in anchors.columns if c != "part"]).alias("anchor"))
    each = blocks.select(F.struct(*[c.split()[0] for c in BLOCK.split(", ")]).alias("block"), F.explode(F.array(*[F.lit(p).cast("long") for p in parts])).alias("part"))
    return each.join(F.broadcast(few), "part").filter("block.dim = anchor.dim").select("part", "block", "anchor")


FOUND = "anchor_row long, anchor_id long, vec_id long, row long, score long"


def _kept(part_lists: dict, wanted) -> Iterator[dict]:
    """Result rows of the best lists of a task."""
    import numpy as np

    for anchors, lists in part_lists.values():
        sizes = [len(x[0]) for x in lists]
        if sum(sizes):
            ids, rows, scores = (np.concatenate([x[i] for x in lists]) for i in range(3))
            yield {"anchor_row": np.repeat(anchors[1], sizes), "anchor_id": np.repeat(anchors[0], sizes), "vec_id": ids, "row": rows, "score": scores}


def positives_of(blocks: Iterator[dict]) -> Iterator[dict]:
    """For each anchor its best ``POSITIVES`` other rows of the same label, among the rows of a partition."""
    import numpy as np

    lists: dict[int, tuple] = {}
    for pair in blocks:
        ids, rows, labels, points = unpacked(pair["block"])
        a_ids, a_rows, a_labels, a_points = unpacked(pair["anchor"])
        _, mine = lists.setdefault(pair["part"], ((a_ids, a_rows), [(np.zeros(0, np.int64),) * 3 for _ in a_ids]))
        bound = np.array([min(x[2], default=0) if len(x[2]) >= POSITIVES else np.iinfo(np.int64).min for x in mine])[:, None]
        alive = (a_labels[:, None] == labels[None, :]) & (a_rows[:, None] != rows[None, :])
        at, found, scores = sliced(a_points, points, alive, lambda low, high, alive: high >= np.maximum(bound, kth(low, alive, POSITIVES)))
        for i in np.unique(at):
            new = at == i
            ids_, rows_, scores_ = (np.concatenate(x) for x in zip(mine[i], (ids[found[new]], rows[found[new]], scores[new])))
            some = best(ids_, rows_, scores_, POSITIVES)
            mine[i] = ids_[some], rows_[some], scores_[some]
    yield from _kept(lists, None)


def negatives_of(blocks: Iterator[dict]) -> Iterator[dict]:
    """For each anchor the rows of other labels that are among the first ``NEGATIVES`` for one of its positives, among the rows of a
    partition. The anchors' blocks hold the scores of their positives, as bytes in ``scores``; the least number stands for none."""
    import numpy as np

    lists: dict[int, tuple] = {}
    none = np.iinfo(np.int64).min
    for pair in blocks:
        ids, rows, labels, points = unpacked(pair["block"])
        a_ids, a_rows, a_labels, a_points = unpacked(pair["anchor"])
        given = np.frombuffer(pair["anchor"]["scores"], "<i8").reshape(len(a_ids), POSITIVES)
        there = given > none
        lo = np.where(there, -((-LOW * np.where(there, given, 0)) // 100), 1)
        hi = np.where(there, (HIGH * np.where(there, given, 0)) // 100, 0)  # an empty range for positives that aren't there
        _, mine = lists.setdefault(pair["part"], ((a_ids, a_rows), [(np.zeros(0, np.int64),) * 3 for _ in a_ids]))
        bounds = np.full(given.shape, none)
        for i, (_, _, s) in enumerate(mine):
            for p in range(POSITIVES):
                inside = np.sort(s[(s >= lo[i, p]) & (s <= hi[i, p])])
                if len(inside) >= NEGATIVES:
                    bounds[i, p] = inside[-NEGATIVES]

        def qualifies(low, high, alive):
            ok = np.zeros(alive.shape, bool)
            for p in range(POSITIVES):
                l, h = lo[:, p : p + 1], hi[:, p : p + 1]
                sure = alive & (low >= l) & (high <= h)
                least = kth(low, sure, NEGATIVES) if sure.any() else none
                ok |= (high >= np.maximum(l, np.maximum(bounds[:, p : p + 1], least))) & (low <= h)
            return ok

        alive = (a_labels[:, None] != labels[None, :]) & there.any(1)[:, None]
        at, found, scores = sliced(a_points, points, alive, qualifies)
        for i in np.unique(at):
            new = at == i
            ids_, rows_, scores_ = (np.concatenate(x) for x in zip(mine[i], (ids[found[new]], rows[found[new]], scores[new])))
            some = np.zeros(len(ids_), bool)
            for p in range(POSITIVES):
                inside = np.flatnonzero((scores_ >= lo[i, p]) & (scores_ <= hi[i, p]))
                some[inside[best(ids_[inside], rows_[inside], scores_[inside], NEGATIVES)]] = True
            mine[i] = ids_[some], rows_[some], scores_[some]
    yield from _kept(lists, None)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows of each ``by`` with their rank; each task of the passes gave at most a few for an anchor."""
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mined(vectors: DataFrame, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows of (vec_id, embedding, label).

    Rows without a usable vector, a label or a vec_id take no part. Rows of one vec_id are different rows: each can be
    a positive of the other, and each anchor among them has its own results, which are the same rows if they are equal; ties of
    score and vec_id are in an order of rows fixed for the call. Vectors of different dimensions have no product and never meet.
    Further columns don't matter; an empty table gives no rows. Anchors without positives or whose positives have no row within
    range give none.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
    rows = cut(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), label.cast("long").alias("label"), integers("embedding").alias("v")), "vectors")
    blocks = cut(packed(rows, ROWS), "blocks")
    asked = rows.filter(F.col("vec_id") % every == 0)
    n = -(-asked.count() // ANCHORS)
    # few partitions of whole blocks; the order within them doesn't matter
    anchors = cut(packed(asked.repartition(max(n, 1)), ANCHORS).withColumn("part", F.monotonically_increasing_id()), "anchors")
    parts = [r["part"] for r in anchors.select("part").toLocalIterator()]
    passes = [parts[i : i + PASS] for i in range(0, len(parts), PASS)]

    def all_passes(work, against: DataFrame, name: str) -> DataFrame:
        done = [cut(over_blocks(_meeting(blocks, against, p), work, FOUND), name) for p in passes]
        out = rows.sparkSession.createDataFrame([], FOUND) if not done else done[0]
        for more in done[1:]:
            out = out.union(more)
        return out

    positives = cut(_first(all_passes(positives_of, anchors, "same"), ["anchor_row"], POSITIVES), "positives")
    # the scores of an anchor's positives go to its place in its block
    scored = positives.groupBy("anchor_row").agg(F.collect_list("score").alias("scores"))
    against = cut(with_scores(anchors, scored), "anchors")
    found = all_passes(negatives_of, against, "other").select("anchor_row", F.col("vec_id"), F.col("row"), "score")
    ranges = positives.select("anchor_row", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("row").alias("positive_row"), F.col("score").alias("positive_score"))
    within = found.join(ranges, "anchor_row").filter((LOW * F.col("positive_score") <= 100 * F.col("score")) & (100 * F.col("score") <= HIGH * F.col("positive_score")))
    out = _first(within, ["anchor_row", "positive_row"], NEGATIVES).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = cut(out, "negatives")
    discard(rows, blocks, anchors, against, positives)
    return out


def with_scores(anchors: DataFrame, scored: DataFrame) -> DataFrame:
    """The blocks of anchors with ``scores``: ``POSITIVES`` longs for each of their vectors, filled up with the least number."""
    rows = over_blocks(anchors, _places, "part long, place int, anchor_row long")
    filled = rows.join(scored, "anchor_row", "left").groupBy("part").agg(F.array_sort(F.collect_list(F.struct("place", "scores"))).alias("by_place"))

    def run(blocks: Iterator[dict]) -> Iterator[dict]:
        import numpy as np

        for b in blocks:
            out = np.full((b["n"], POSITIVES), np.iinfo(np.int64).min, "<i8")
            for i, x in enumerate(b["by_place"]):
                some = x["scores"] or []
                out[i, : len(some)] = some
            yield {c: [b[c]] for c in b if c != "by_place"} | {"scores": [out.tobytes()]}

    return over_blocks(anchors.join(filled, "part"), run, f"part long, {BLOCK}, scores binary")


def _places(blocks: Iterator[dict]) -> Iterator[dict]:
    import numpy as np

    for b in blocks:
        yield {"part": np.full(b["n"], b["part"], np.int64), "place": np.arange(b["n"], dtype=np.int32), "anchor_row": np.frombuffer(b["rows"], "<i8")}


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP11_SQL = f"""WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM usable),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.c) + 1), lambda i: a.c[i] * b.c[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.c) = len(b.c) WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(ROW_NUMBER() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
 FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
 QUALIFY rank <= {NEGATIVES}"""
