"""The stored family of suffix arrays: batches against one call and against brute force."""

import pytest
from pyspark.sql import functions as F

from tracelens.llm import suffix, suffix_index

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def brute(docs):
    """n_removed of each document: bytes covered by 50-byte strings that a smaller doc_id has."""
    first, out = {}, {}
    for d, raw in docs:
        for i in range(len(raw) - 49):
            first[raw[i : i + 50]] = min(first.get(raw[i : i + 50], d), d)
    for d, raw in docs:
        out[d] = len({k for i in range(len(raw) - 49) if first[raw[i : i + 50]] < d for k in range(i, i + 50)})
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")


def test_three_batches_give_what_one_call_gives(spark, docs, tmp_path):
    """The index is opened anew for each batch, so all it knows comes from its folder."""
    a, b = docs.approxQuantile("doc_id", [0.5, 0.7], 0.0)
    parts = [docs.filter(F.col("doc_id") <= a), docs.filter((F.col("doc_id") > a) & (F.col("doc_id") <= b)), docs.filter(F.col("doc_id") > b)]
    out = []
    for part in parts:
        out += rows(suffix_index.Index(spark, f"{tmp_path}/index", 1 << 20).append(part))
    assert sorted(out, key=repr) == rows(suffix.removal_report(docs))
    assert sum(r[2] for r in out) > 0 and {r[0] for r in out if r[2]} & {r[0] for r in parts[2].collect()}
    index = suffix_index.Index(spark, f"{tmp_path}/index")
    assert index.slices == 8 and index.number == 3
    sizes = [n for _, n in index.levels]
    assert all(x >= 2 * y for x, y in zip(sizes, sizes[1:]))
    # every different string stands in one level and once in it: those of later batches that are known stay known by the smallest doc_id
    text = [bytes(r["text"] or "", "utf-8") for r in docs.collect()]
    assert sum(sizes) >= len({x[i : i + 50] for x in text for i in range(len(x) - 49)})
    # again: nothing changes
    assert rows(index.append(parts[1])) == sorted((r for r in out if a < r[0] <= b), key=repr)


def test_levels_merge_and_bytes_are_judged_by_brute_force(spark, tmp_path):
    import random

    r, texts = random.Random(4), []
    pool = ["".join(r.choice("abü\0") for _ in range(90)) for _ in range(6)]
    for i in range(24):
        texts.append((i, "".join(r.choice("xyz") for _ in range(r.randint(0, 60))) + "".join(x[r.randint(0, 30) :] for x in r.sample(pool, r.randint(0, 3)))))
    index, out = suffix_index.Index(spark, f"{tmp_path}/index"), {}
    for lo in range(0, 24, 4):
        frame = spark.createDataFrame(texts[lo : lo + 4], "doc_id long, text string")
        out |= {x["doc_id"]: x["n_removed"] for x in index.append(frame).collect()}
    assert out == brute([(i, t.encode()) for i, t in texts]) and any(out.values())
    assert len(index.levels) <= 4


def test_smaller_ids_later_and_odd_rows(spark, tmp_path):
    index = suffix_index.Index(spark, f"{tmp_path}/index")
    long, kind = "".join(chr(97 + i * i % 23) for i in range(80)), "doc_id long, text string, starts string, level int"
    frame = lambda *x: spark.createDataFrame([(*y, "s", 1) for y in x], kind)
    assert rows(index.append(frame().filter("false"))) == [] and index.levels == []
    assert {r[:3] for r in rows(index.append(frame((5, long), (5, long), (6, None), (7, ""), (8, "short"))))} == {(5, 80, 0), (6, 0, 0), (7, 0, 0), (8, 5, 0)}
    # 3 takes nothing from 5, as 5 came before; null is smaller than all; rows of one doc_id don't remove from each other, in no batch
    assert {r[:3] for r in rows(index.append(frame((3, long), (5, long + "!"), (9, long))))} == {(3, 80, 0), (5, 81, 80), (9, 80, 80)}
    assert {r[:3] for r in rows(index.append(frame((None, long), (2, long))))} == {(None, 80, 0), (2, 80, 80)}
    assert len(index.levels) == 1


def test_a_failed_append_changes_nothing(spark, docs, tmp_path):
    index = suffix_index.Index(spark, f"{tmp_path}/index", 1 << 20)
    index.append(docs.filter("doc_id < 20"))
    before = index.levels
    bad = docs.filter("doc_id >= 20").withColumn("text", F.when(F.col("doc_id") > 0, F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        index.append(bad)
    index = suffix_index.Index(spark, f"{tmp_path}/index")
    assert index.levels == before and index.number == 1
    assert rows(index.append(docs.filter("doc_id >= 20"))) == [r for r in rows(suffix.removal_report(docs)) if r[0] >= 20]
