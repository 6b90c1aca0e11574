"""Two-level scans against brute force, with a key that has most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from tests import traces as T
from tracelens.operators import automata, loader, objects, scans


@pytest.fixture(scope="module")
def hot():
    """(idx, key, v): key 1 has nine of ten rows, some keys and values are null."""
    rng = random.Random(2)
    return [(i, 1 if rng.random() < 0.9 else rng.choice([2, 3, None]), rng.choice([None, rng.randrange(-9, 9)])) for i in rng.sample(range(1, 5000), 600)]


@pytest.mark.parametrize("how", ["last", "min", "max", "sum"])
@pytest.mark.parametrize("back", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running(spark, hot, how, back, inclusive):
    pick = {"last": lambda v: v[-1], "min": min, "max": max, "sum": sum}[how]
    want = {}
    for i, k, _ in hot:
        seen = sorted((j, v) for j, q, v in hot if q == k and v is not None and ((j > i if back else j < i) or (inclusive and j == i)))
        seen = [v for _, v in (reversed(seen) if back else seen)]
        want[i] = pick(seen) if seen else None
    df = spark.createDataFrame(hot, "idx long, key int, v int")
    got = {r["idx"]: r["x"] for r in scans.running(df, ["key"], "x", F.col("v"), how, inclusive, back, chunk=50).collect()}
    assert got == want


def test_peaks(spark):
    rng = random.Random(4)
    moves = [(1 if rng.random() < 0.9 else 2, rng.choice([None, rng.randrange(400)]), rng.choice([1, -1])) for _ in range(700)]
    want = {}
    for k in (1, 2):
        times = sorted({t for q, t, _ in moves if q == k and t is not None})
        sums = [sum(d for q, t, d in moves if q == k and t is not None and t <= at) for at in times] + [sum(d for q, _, d in moves if q == k)]
        want[k] = max(sums)
    df = spark.createDataFrame(moves, "id int, t long, d int")
    assert {r["id"]: r["peak"] for r in scans.peaks(df, "id", "t", "d", chunk=30).collect()} == want


def test_hot_key_is_spread(spark):
    """One key and 64 chunks: no task has more than its share of the rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(64_000).select(F.col("id").alias("idx"), (F.col("id") % 1).alias("key"))
        out = scans.running(df, ["key"], "x", F.col("idx"), chunk=1000)
        per = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("x")).collect()
        assert sum(r["n"] for r in per) == 64_000 and max(r["n"] for r in per) < 64_000 / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_thread_and_level_in_chunks(spark):
    """A loop on one frame: variables stored over and over, calls one after another, in chunks of 5 events as in one."""
    events = [T.enter("main", 100)]
    for i in range(40):
        events += [T.var(100, i % 2, 200 + i % 5), T.touch(200, i % 3 == 0), T.enter("m", 200 + i % 5), T.store(200, "f", 201 + i % 3), T.leave("m" if i % 7 else "n")]
    events += [T.leave("main")]
    df = T.frame(spark, events).cache()
    whole, parts = loader.load(df), loader.load(df, chunk=5)
    for name in whole:
        assert sorted(map(str, whole[name].collect())) == sorted(map(str, parts[name].collect())), name
    uses = [r for r in parts["uses"].collect() if r["kind"] in ("read", "modify")]
    assert len(uses) == 40 and {r["method"] for r in uses} == {"main"}
    flat = loader.flatten(df)
    for f in (lambda c: automata.loads_from_elsewhere(flat, True, chunk=c), lambda c: automata.max_in_degree(flat, 1, c), lambda c: automata.forever(flat, F.col("kind") != "readmodify", chunk=c), lambda c: objects.max_aliases(parts["refs"], c)):
        assert sorted(map(str, f(5).collect())) == sorted(map(str, f(10**6).collect()))


def test_observe_spans_batches_and_chunks(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(1, 301).select(F.col("id").alias("idx"), F.when(F.col("id") % 10 == 0, F.lit("b")).when(F.col("id") % 97 == 0, None).otherwise("a").alias("callee"), (F.col("id") % 13).alias("v"))
        out = automata.observe(df, "callee", ["idx", "v"], "n long, last long", lambda x: (int(len(x["v"])), int(x["v"][-1])), lambda a, b: (a[0] + b[0], b[1]), lambda s: (s[0], s[1]) == (30, 300 % 13), 40)
        assert {r["key"]: r["accepting"] for r in out.collect()} == {"a": False, "b": True, None: False}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
