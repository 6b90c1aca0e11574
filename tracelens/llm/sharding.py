"""9 Sharding: a Feistel permutation with cycle walking over global row numbers.

Row numbers 0..n-1 come from a digest bucket (counted first, so offsets are a prefix sum over a fixed
number of buckets) and the rank inside the bucket: no total sort, no single-task window over rows.
The permutation acts on Z_a x Z_b with a*b just above n; values at or above n walk on along their cycle
until they fall below n, so it is a bijection of 0..n-1 that anyone can compute for one row alone.
Shard = permuted row mod shards, slot = permuted row div shards: counts differ by at most one and slots
have no gaps. All of it is built-in SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelens.llm.common import blank, byte_length, md5_uint, table

ROUNDS = 6
#: The walk is unrolled for a*b-n+1 steps, which is always enough, or this many (chance of more: n**-8).
MAX_WALK = 16
BUCKETS = 4096
SEED = "tracelens-1"
ROW_OVERHEAD = 16


def domain(n: int) -> tuple[int, int]:
    """Sides of the smallest nearly square grid with at least n cells."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _mix(seed: str, j: Column, x: Column) -> Column:
    return md5_uint(F.concat(F.lit(f"{seed}:"), j.cast("string"), F.lit(":"), x.cast("string")))


def _once(x: Column, a: int, b: int, seed: str) -> Column:
    """One pass of the unbalanced Feistel network over a cell number."""
    start = F.struct(F.pmod(x, F.lit(a)).cast("long").alias("l"), F.floor(x / F.lit(a)).cast("long").alias("r"))
    def step(s, j):
        return F.when(
            j % 2 == 0,
            F.struct(F.pmod(s["l"] + _mix(seed, j, s["r"]), F.lit(a)).cast("long").alias("l"), s["r"].alias("r")),
        ).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + _mix(seed, j, s["l"]), F.lit(b)).cast("long").alias("r")))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    # `done` is named once, in a one-element array, so that it isn't evaluated twice
    return F.element_at(F.transform(F.array(done), lambda s: s["l"] + s["r"] * F.lit(a)), 1)


def permuted(row: Column, n: int, seed: str = SEED) -> Column:
    """Where row number ``row`` of ``n`` goes. A bijection of 0..n-1."""
    a, b = domain(n)
    walks = min(a * b - n, MAX_WALK)
    first = _once(row, a, b, seed)
    if not walks:
        return first
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(walks)), first, lambda x, _: F.when(x < F.lit(n), x).otherwise(_once(x, a, b, seed))
    )
    return F.element_at(
        F.transform(F.array(walked), lambda x: F.when(x < F.lit(n), x).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))), 1
    )


def numbered(df: DataFrame, key: Column, order: list[Column], buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """Adds ``row_number`` 0..n-1 and returns n. ``key`` picks the bucket; ``order`` ranks inside it."""
    df = df.withColumn("_bucket", F.pmod(md5_uint(key), F.lit(buckets)).cast("int"))
    counts = sorted(df.groupBy("_bucket").count().collect())  # at most `buckets` rows
    offsets, n = [], 0
    for bucket, count in counts:
        offsets.append((bucket, n))
        n += count
    spark = df.sparkSession
    before = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "_bucket int, _before long"))
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy("_bucket").orderBy(*order)) - 1)
    return ranked.join(before, "_bucket").withColumn("row_number", F.col("_before") + F.col("_rank")).drop("_bucket", "_before", "_rank"), n


def feistel_shards(docs: DataFrame, n_shards: int = 40, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Null text counts as empty (size 16). Rows with null or repeated doc_id are rows like any other; fully
    equal rows take adjacent row numbers, in no defined order among themselves. An empty table gives no rows.
    """
    rows = docs.select(
        "doc_id", (byte_length("text") + ROW_OVERHEAD).alias("size"), F.crc32(blank("text").cast("binary")).cast("long").alias("text_crc32")
    )
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    rows, n = numbered(rows, key, [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")], buckets)
    return rows.withColumn("_p", permuted(F.col("row_number"), n, seed)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("_p", F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(F.col("_p") / n_shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards(table(spark, sf_dir, "documents"))



def _sql_pass(source: str) -> str:
    """One pass of the network over the column x of ``source``, as nested sub-queries."""
    out = f"SELECT row_no, a, b, n, x % a AS l, x // a AS r FROM ({source})"
    for j in range(ROUNDS):
        mixed = lambda c, j=j: f"CAST('0x' || substr(md5('{SEED}:{j}:' || {c}), 1, 8) AS BIGINT)"
        new = f"(l + {mixed('r')}) % a AS l, r" if j % 2 == 0 else f"l, (r + {mixed('l')}) % b AS r"
        out = f"SELECT row_no, a, b, n, {new} FROM ({out})"
    return f"SELECT row_no, a, b, n, l + a * r AS x FROM ({out})"


OP9_SQL = f"""
WITH RECURSIVE c(i, k, v) AS (  -- the reflected CRC-32 table, from its rule
  SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM c WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT doc_id, length(h) // 2 + {ROW_OVERHEAD} AS size, xor(list_reduce(list_transform(range(1, length(h) // 2 + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT)),
  lambda crc, byte: xor(crc >> 8, tab[(xor(crc, byte) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM d, tab),
k AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || text_crc32), 1, 8) AS BIGINT) % {BUCKETS} AS bucket FROM e),
r AS (SELECT *, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS row_no, count(*) OVER () AS n FROM k),
s AS (SELECT row_no, n, row_no AS x, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM r),
g AS (SELECT row_no, n, x, a, (n + a - 1) // a AS b FROM s),
w AS ({_sql_pass('SELECT * FROM g')} UNION ALL {_sql_pass('SELECT * FROM w WHERE x >= n')})
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(x % 40 AS INTEGER) AS shard, CAST(x // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM r JOIN w USING (row_no) WHERE w.x < w.n
"""
