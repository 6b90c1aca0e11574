"""Scans in order of idx in two levels, for keys of which one may have most of the rows.

The rows of a key are cut into chunks by idx. A first level works within (key, chunk), so a hot key is spread over as many tasks as it
has chunks; a second level carries one row a chunk on to the chunks that follow. All rows are shuffled once, by (key, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values of idx that one chunk covers.
CHUNK = 1_000_000

_HOW = {
    "last": (lambda v: F.last(v, ignorenulls=True), lambda near, far: F.coalesce(near, far)),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "sum": (F.sum, lambda near, far: F.coalesce(near + far, near, far)),
}


def running(df: DataFrame, by: list[Column | str], out: str, value: Column, how: str = "last", inclusive: bool = True, back: bool = False, chunk: int = CHUNK, order: str = "idx") -> DataFrame:
    """``df`` with ``out``: last, min, max or sum of the non-null ``value``s of a key's rows up to this one (``inclusive``) or before it.

    ``back`` runs from the end, so the last value before a row is the next one after it. Null parts of a key are equal to each other;
    ``order`` must not be null, and rows of one key that share a value of it come in no fixed order.
    """
    within, joined = _HOW[how]
    at = F.col(order)
    rows = df.withColumn("_key", F.struct(*by)).withColumn("_chunk", F.floor(at / chunk)).withColumn("_value", value)
    local = W.partitionBy("_key", "_chunk").orderBy(at.desc() if back else at.asc()).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    if how == "last":
        pick = F.min if back else F.max
        of_chunk = pick(F.when(F.col("_value").isNotNull(), F.struct(at.alias("at"), F.col("_value").alias("value"))))["value"]
    else:
        of_chunk = within("_value")
    parts = rows.groupBy("_key", "_chunk").agg(of_chunk.alias("_part"))
    earlier = W.partitionBy("_key").orderBy(F.col("_chunk").desc() if back else F.col("_chunk").asc()).rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select("_key", "_chunk", within(F.col("_part")).over(earlier).alias("_far"))
    rows = rows.withColumn("_near", within(F.col("_value")).over(local)).join(carried, ["_key", "_chunk"])
    return rows.withColumn(out, joined(F.col("_near"), F.col("_far"))).drop("_key", "_chunk", "_value", "_near", "_far")


def peaks(moves: DataFrame, key: str, time: Column | str, delta: Column | str, chunk: int = CHUNK) -> DataFrame:
    """key, peak: the greatest running sum of ``delta`` over a key's moves in order of ``time``. Moves of one time count together; those
    without a time come after all others.

    A chunk of a key is summed up as (sum, greatest prefix sum), which is all that the chunks after it need to know.
    """
    at, d = F.col(time) if isinstance(time, str) else time, F.col(delta) if isinstance(delta, str) else delta
    rows = moves.select(F.col(key).alias("_key"), at.alias("_time"), d.cast("long").alias("_delta"), F.coalesce(F.floor(at / chunk), F.lit(2**62)).alias("_chunk"))
    # up to the current row's time: rows of one time see the same sum
    prefix = F.sum("_delta").over(W.partitionBy("_key", "_chunk").orderBy(F.col("_time").asc_nulls_last()).rangeBetween(W.unboundedPreceding, W.currentRow))
    parts = rows.withColumn("_prefix", prefix).groupBy("_key", "_chunk").agg(F.sum("_delta").alias("total"), F.max("_prefix").alias("top"))
    base = F.coalesce(F.sum("total").over(W.partitionBy("_key").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parts.select("_key", (base + F.col("top")).alias("top")).groupBy(F.col("_key").alias(key)).agg(F.max("top").alias("peak"))
