"""1 Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Texts are lower-cased in A-Z and cut into words. A test item gives its windows of ``n`` consecutive words, or
itself as one window if it is shorter. Documents are scanned in blocks of words. Wherever a window of k words stands,
it holds a run of ``RUN`` words at a place that is divisible by k - RUN + 1, so only the runs at these places are
hashed and looked up among those of the windows. The windows around a run that is found are looked up in the hash set
by their whole text (so a hit is verified by equality, not by digest), and the hits of a document are merged to word
spans. Documents or spans are removed. Built-in SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import blank, cut, digest, sha_hex, table, whole

N = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before they are lower-cased.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block; bounds the memory that a very long text takes.
BLOCK = 512
#: Words of a run; windows of fewer words are runs themselves.
RUN = 4
#: The hash set is broadcast up to this many bytes of windows and item ids; beyond, the join shuffles.
MAX_BROADCAST = 64 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP), "")


def windows(ws: Column, length: Column | int, first: Column, last: Column) -> Column:
    """Windows of ``length`` words starting at ``first``..``last`` (1-based): (at, window); empty if last < first."""
    length = F.lit(length) if isinstance(length, int) else length
    starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(ws, i, length), " ").alias("window")))


def test_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """window, n_window (its words), items (sorted ids that hold it)."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(blank("text")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    each = w.select("item", length.alias("n_window"), F.explode(windows(F.col("w"), length, F.lit(1), F.size("w") - length + 1)).alias("x"))
    return each.groupBy(F.col("x.window").alias("window"), "n_window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def run(ws: Column, at: Column, k: int) -> Column:
    """Hash of the run of a window of k words that starts at the 1-based place ``at``."""
    return F.xxhash64(*[ws[at + (j - 1)] for j in range(min(RUN, k))])


def stride(k: int) -> int:
    """Of so many runs in a row that a window of k words holds, one is at a place divisible by this."""
    return k - min(RUN, k) + 1


def test_runs(grams: DataFrame, lengths: list[int]) -> DataFrame:
    """n_window, run: the hashes of all runs of the windows."""

    def of_length(k: int) -> Column:
        return F.when(F.col("n_window") == k, F.transform(F.sequence(F.lit(1), F.lit(stride(k))), lambda i: run(F.col("w"), i, k)))

    runs, none = map(of_length, lengths), F.array().cast("array<bigint>")
    return grams.select("n_window", F.split("window", " ").alias("w")).select("n_window", F.explode(F.coalesce(*runs, none)).alias("run")).distinct()


def looked_up(docs: DataFrame, runs: DataFrame, lengths: list[int], n: int = N) -> DataFrame:
    """doc_id, digest, start, n_window, window: the windows of ``docs`` that hold a run of ``runs`` at a place of their stride,
    which none that equals a window of the benchmark lacks."""
    ws = docs.select("doc_id", F.xxhash64(blank("text")).alias("digest"), words(blank("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(BLOCK))
    blocks = ws.select("doc_id", "digest", F.explode(F.transform(starts, lambda b: F.struct(b.alias("base"), F.slice("w", b + 1, BLOCK + n - 1).alias("w")))).alias("b"))
    w = F.col("b.w")

    def of_length(k: int) -> Column:
        step = stride(k)
        last = F.least(F.lit(BLOCK + step - 1), F.size(w) - min(RUN, k) + 1)
        at = F.when(last >= step, F.sequence(F.lit(step), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
        # the windows that hold the run start at one of the ``step`` places up to it
        return F.transform(at, lambda p: F.struct(
            F.lit(k).alias("n_window"), run(w, p, k).alias("run"), (p - step).alias("before"), F.slice(w, p - (step - 1), step + k - 1).alias("w")))

    per_length = [of_length(k) for k in lengths] or [F.array().cast("array<struct<n_window:int,run:bigint,before:int,w:array<string>>>")]
    each = blocks.select("doc_id", "digest", F.col("b.base").alias("base"), F.explode(F.concat(*per_length)).alias("x"))
    each = each.select("doc_id", "digest", (F.col("base") + F.col("x.before")).alias("base"), "x.n_window", "x.run", "x.w").join(runs, ["n_window", "run"])
    found = windows(F.col("w"), F.col("n_window"), F.lit(1), F.size("w") - F.col("n_window") + 1)
    each = each.select("doc_id", "digest", "base", "n_window", F.explode(found).alias("x"))
    return each.select("doc_id", "digest", (F.col("base") + F.col("x.at") - 1).alias("start"), "n_window", F.col("x.window").alias("window"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """doc_id, digest, spans (merged, 0-based word positions: start, end), items; only documents with hits."""
    grams = test_windows(benchmark, n)
    size = grams.agg(F.sum(F.octet_length("window") + 40 + F.octet_length(F.array_join("items", ",")) + 24 * F.size("items")).alias("bytes"), F.sort_array(F.collect_set("n_window")).alias("lengths")).first()
    lengths, runs = size["lengths"] or [], test_runs(grams, size["lengths"] or [])
    held, runs = (F.broadcast(grams), F.broadcast(runs)) if (size["bytes"] or 0) <= MAX_BROADCAST else (grams, runs)
    found = looked_up(docs, runs, lengths, n).join(held, ["window", "n_window"])
    per = found.groupBy("doc_id", "digest").agg(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n_window")).alias("end")))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return per.select("doc_id", "digest", merged(F.col("runs")).alias("spans"), "items")


def merged(runs: Column) -> Column:
    """Sorted (start, end) runs, with those that touch or overlap joined."""
    kind = "array<struct<start:int,end:int>>"

    def step(acc, r):
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= r["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        ).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(runs.cast(kind), F.array().cast(kind), step)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null text has no words; null item_id counts as ''. Repeated rows stay, each with its result; a document and
    its copies are scanned alike. Without items (or with none that has words) nothing is hit.
    """
    found = hits(docs, benchmark, n)
    rows = docs.select("doc_id", F.xxhash64(blank("text")).alias("digest"), F.size(words(blank("text"))).cast("long").alias("n_words"))
    items = F.coalesce(F.col("f.items"), F.array().cast("array<string>"))
    n_hit = F.aggregate(F.coalesce(F.col("f.spans"), F.array().cast("array<struct<start:int,end:int>>")), F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    joined = rows.alias("r").join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.digest") == F.col("f.digest")), "left")
    return joined.select(
        F.col("r.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        sha_hex(F.array_join(items, ",")).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words of the spans and the gaps that follow them."""
    gaps, ws = F.split(text, CASED_WORD), F.regexp_extract_all(text, F.lit(CASED_WORD), F.lit(0))
    parts = F.transform(ws, lambda w, i: F.when(F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"])), "").otherwise(F.concat(w, F.element_at(gaps, i + 2))))
    return F.concat(F.element_at(gaps, 1), F.array_join(parts, ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, remove: str = "documents") -> DataFrame:
    """``docs`` without the documents that have a hit, or (``remove="spans"``) with the hit words cut out of
    ``text``. Other columns, repeated rows and null texts stay as they are."""
    found = hits(docs.select("doc_id", "text"), benchmark, n)
    found = cut(found.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_hit"), F.col("spans").alias("_spans")), "hits")
    most = found.agg(F.sum(F.size("_spans") * 8 + 60).alias("bytes")).first()["bytes"] or 0
    found = F.broadcast(found) if most <= MAX_BROADCAST else found
    rows = whole(docs, F.col("doc_id").alias("_doc"), digest().alias("_digest"))
    on = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_hit"))
    if remove == "documents":
        return rows.join(found.drop("_spans"), on, "left_anti").select("_row.*")
    text = F.when(F.col("_spans").isNull(), F.col("_row.text")).otherwise(without_spans(F.col("_row.text"), F.col("_spans")))
    joined = rows.join(found, on, "left").select("_row", text.alias("_text"))
    return joined.select(*[(F.col("_text") if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP1_SQL = f"""
WITH b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT item_id, least(len(w), {N}) AS k, array_to_string(list_slice(w, i, i + least(len(w), {N}) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {N}) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM g),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, i, dw.k AS k, item_id FROM dw JOIN g ON dw.win = g.win AND dw.k = g.k),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
