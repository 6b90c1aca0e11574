"""4 Suffix-array dedup: a logarithmic family of suffix arrays.

Bytes covered by a 50-byte string that also starts in a document with a smaller doc_id go. The corpus is cut in
independent slices by content: every 50-byte string has a smallest 16-byte hash (a minimizer), equal strings
have equal ones, and a slice holds the strings of its share of minimizers, as runs of neighbouring strings.

1. Each text gives the starts and minimizers of its runs, packed in blocks for the slices.
2. A slice keeps the runs whose minimizer occurs in two documents; only these can hold a shared string.
3. Their bytes are cut out of the texts and go to the slices.
4. A slice goes through its documents in order of doc_id, in batches. A batch gets a suffix array (its 50-byte strings, sorted),
   is merge-scanned against the arrays of the levels for strings of earlier documents, and becomes a level itself;
   levels of nearly equal size are merged, so there are logarithmically many. Runs that are equal as a whole are looked up as a whole.
5. The covered ranges go back to the documents.

A slice holds a hash share of the corpus; the number of slices follows ``spark.sql.shuffle.partitions``, which has to be set to suit the input. Of the
runs of one document only about two in a hundred bytes' worth start with the same minimizer, so a string that a third of all
documents share is a small part of one slice.

The levels of step 4 live for one call. ``suffix_index`` has a family that is stored and to which later batches are appended.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import blank, byte_length, cut, sized, table

LENGTH, GRAM = 50, 16
#: Bytes of text that are handled at once; longer texts are handled alone.
BLOCK_BYTES = 2_000_000
#: Strings of a batch.
BATCH_STRINGS = 200_000
#: Slices for each shuffle partition, and the fewest.
SLICES_PER_PARTITION, LEAST_SLICES = 4, 64
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def runs(raw: bytes, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start in the text, bytes, minimizer) of the maximal runs of strings with one minimizer.
    ``raw``: the texts one after another; ``starts``: their first bytes and the end. Strings don't cross texts."""
    n = len(raw) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64)
    b = np.frombuffer(raw + bytes(8), np.uint8)
    words = np.ndarray((len(raw) - gram + 9,), np.uint64, buffer=b, strides=(1,))  # eight bytes from each place on
    h = words[: len(raw) - gram + 1] * _A
    h ^= h >> np.uint64(29)
    h += words[8 : len(raw) - gram + 9] * _B
    h ^= h >> np.uint64(32)
    h *= _A
    h ^= h >> np.uint64(29)
    wide, at = h, 1
    span = length - gram + 1
    while at * 2 <= span:
        wide = np.minimum(wide[:-at], wide[at:])
        at *= 2
    least = np.minimum(wide[:n], wide[span - at : span - at + n])
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:n]
    ok = np.arange(n) + length <= starts[text + 1]
    fresh = np.ones(n, bool)
    fresh[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~ok[:-1]
    first = np.flatnonzero(fresh & ok)
    if not len(first):
        return none, none, none, none.astype(np.uint64)
    stops = np.append(np.flatnonzero(fresh | ~ok), n)
    end = stops[np.searchsorted(stops, first, "right")]
    owner = text[first]
    return owner, first - starts[owner], end - first + length - 1, least[first]


def _pack(x: np.ndarray) -> bytes:
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpack(data: bytes, kind, n: int) -> np.ndarray:
    import pyarrow as pa

    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _texts(batch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of pieces of about BLOCK_BYTES."""
    lo, held, out = 0, 0, []
    for i, t in enumerate(batch.column(column)):
        out.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
        held += len(out[-1])
        if held >= BLOCK_BYTES:
            yield lo, out
            lo, held, out = i + 1, 0, []
    if out:
        yield lo, out


def _by_slice(slices: int, minimizer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, slice numbers that occur, their bounds in the order)."""
    at = (minimizer & np.uint64(0xFFFFFFFF)) % np.uint64(slices)
    order = np.argsort(at.astype(np.int64), kind="stable")
    which, first = np.unique(at[order], return_index=True)
    return order, which.astype(np.int64), np.append(first, len(order))


def _starts_of(slices: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys, docs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, texts in _texts(batch, 2):
                owner, start, _, least = runs(b"".join(texts), np.cumsum([0, *map(len, texts)]))
                order, which, bounds = _by_slice(slices, least)
                key, doc = (x[lo : lo + len(texts)][owner][order] if len(order) else np.zeros(0, np.int64) for x in (keys, docs))
                high, start = (least >> np.uint64(32)).astype(np.uint32)[order], start.astype(np.uint32)[order]
                rows = []
                for i, s in enumerate(which):
                    a, b = bounds[i], bounds[i + 1]
                    rows.append((int(s), int(b - a), _pack(high[a:b]), _pack(np.diff(key[a:b], prepend=0)), _pack(doc[a:b] - key[a:b]), _pack(start[a:b])))
                if rows:
                    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["slice", "n", "high", "keys", "docs", "starts"])

    return run


def _shared(batches: Iterator) -> Iterator:
    """Of the slices of a task: the runs whose minimizer two documents have."""
    import pyarrow as pa

    held: dict[int, list] = {}
    for batch in batches:
        for s, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(s, []).append(rest)
    for parts in held.values():
        high = np.concatenate([_unpack(p[1], np.uint32, p[0]) for p in parts])
        key = np.concatenate([np.cumsum(_unpack(p[2], np.int64, p[0])) for p in parts])
        doc = key + np.concatenate([_unpack(p[3], np.int64, p[0]) for p in parts])
        start = np.concatenate([_unpack(p[4], np.uint32, p[0]) for p in parts])
        order = np.argsort(high, kind="stable")
        high, key, doc, start = high[order], key[order], doc[order], start[order]
        first = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
        many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        keep = np.repeat(many, np.diff(np.append(first, len(high))))
        key, start = key[keep], start[keep]
        order = np.lexsort((start, key))
        key, start = key[order], start[order]
        if len(key):
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(heads[1:], len(key))
            blobs = [start[a:b].tobytes() for a, b in zip(heads, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(key[heads]), pa.array(blobs, pa.binary())], names=["key", "starts"])


def _bytes_of(slices: int, every: bool = False):
    """The runs with the wanted starts of each text, or all, packed for the slices."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys, docs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, texts in _texts(batch, 3):
                raw, begins = b"".join(texts), np.cumsum([0, *map(len, texts)])
                owner, start, size, least = runs(raw, begins)
                if not every:
                    wanted = [np.frombuffer(b"".join(x.as_py()), np.uint32).astype(np.int64) + begins[i] for i, x in enumerate(batch.column(2)[lo : lo + len(texts)])]
                    pick = np.flatnonzero(np.isin(start + begins[owner], np.concatenate(wanted)))
                    owner, start, size, least = owner[pick], start[pick], size[pick], least[pick]
                order, which, bounds = _by_slice(slices, least)
                owner, start, size = owner[order], start[order], size[order]
                key, doc, begin = keys[lo : lo + len(texts)][owner], docs[lo : lo + len(texts)][owner], start + begins[owner]
                rows = []
                for i, s in enumerate(which):
                    a, b = bounds[i], bounds[i + 1]
                    data = b"".join(raw[x : x + y] for x, y in zip(begin[a:b].tolist(), size[a:b].tolist()))
                    rows.append((int(s), int(b - a), len(data), _pack(np.diff(key[a:b], prepend=0)), _pack(doc[a:b] - key[a:b]), _pack(start[a:b].astype(np.uint32)),
                        _pack(size[a:b].astype(np.uint32)), pa.compress(data, codec="zstd", asbytes=True)))
                if rows:
                    kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["slice", "n", "n_bytes", "keys", "docs", "starts", "sizes", "data"])

    return run


class Family:
    """Sorted 50-byte strings with the smallest key they occur under, in levels of geometric sizes."""

    def __init__(self, length: int = LENGTH):
        self.length, self.levels = length, []

    def scan(self, pool: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """For a batch of strings (places in ``pool``, keys not below those of earlier batches and ascending): which of
        them occur under a smaller key. The batch is added."""
        strings = pool[at[:, None] + np.arange(self.length)].view(f"S{self.length}").ravel()
        order = np.argsort(strings, kind="stable")  # the suffix array of the batch; equal strings stay in key order
        ranked, keys = strings[order], key[order]
        head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.cumsum(head) - 1
        kinds, least = ranked[head], keys[head].copy()
        fresh = np.ones(len(kinds), bool)
        for level, owners in self.levels:
            spot = np.searchsorted(level, kinds)
            found = spot < len(level)
            found[found] = level[spot[found]] == kinds[found]
            least[found] = np.minimum(least[found], owners[spot[found]])
            fresh &= ~found
        hit = np.zeros(len(at), bool)
        hit[order] = least[group] < keys
        self.add(kinds[fresh], least[fresh])
        return hit

    def add(self, strings: np.ndarray, keys: np.ndarray) -> None:
        if len(strings):
            self.levels.append((strings, keys))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels[-2:]
            both = np.concatenate([a, b])
            order = np.argsort(both, kind="stable")  # two sorted runs: a merge
            self.levels[-2:] = [(both[order], np.concatenate([x, y])[order])]


def covered(keys: np.ndarray, sizes: np.ndarray, data: bytes, length: int = LENGTH, batch: int = BATCH_STRINGS) -> list[tuple[int, int, int]]:
    """(run number, from, to) for the byte ranges of runs that hold a string of a smaller key. Runs ascend by key."""
    begin = np.concatenate([[0], np.cumsum(sizes)])
    first: dict[bytes, int] = {}
    out, own = [], []
    for i, (a, b, k) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), keys.tolist())):
        whole = data[a:b]
        lead = first.setdefault(whole, k)
        if lead != k:
            out.append((i, 0, b - a))  # the whole run stands in an earlier document
        else:
            own.append(i)
    own = np.array(own, np.int64)
    pool, family = np.frombuffer(data, np.uint8), Family(length)
    strings = sizes[own].astype(np.int64) - length + 1
    ends, lo = np.cumsum(strings), 0
    while lo < len(own):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + batch, "right")))
        run = np.repeat(np.arange(lo, hi), strings[lo:hi])
        inside = np.arange(len(run)) - (ends - strings - done)[run]
        hit = family.scan(pool, begin[own[run]] + inside, keys[own[run]])
        edge = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (run[1:] != run[:-1])]))
        last = np.flatnonzero(hit & np.concatenate([~hit[1:] | (run[1:] != run[:-1]), [True]]))
        out += zip(own[run[edge]].tolist(), inside[edge].tolist(), (inside[last] + length).tolist())
        lo = hi
    return out


def joined(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(keys, docs, starts, sizes, bytes) of the runs of a slice, ascending by doc. ``parts`` is emptied."""
    import pyarrow as pa

    key = np.concatenate([np.cumsum(_unpack(p[2], np.int64, p[0])) for p in parts])
    doc = key + np.concatenate([_unpack(p[3], np.int64, p[0]) for p in parts])
    start = np.concatenate([_unpack(p[4], np.uint32, p[0]) for p in parts]).astype(np.int64)
    size = np.concatenate([_unpack(p[5], np.uint32, p[0]) for p in parts]).astype(np.int64)
    data = b"".join(pa.decompress(p[6], p[1], codec="zstd", asbytes=True) for p in parts)
    parts.clear()
    order = np.argsort(doc, kind="stable")
    begin = np.cumsum(size) - size
    data = b"".join(data[a : a + n] for a, n in zip(begin[order].tolist(), size[order].tolist()))
    return key[order], doc[order], start[order], size[order], data


def _scan(batches: Iterator) -> Iterator:
    import pyarrow as pa

    held: dict[int, list] = {}
    for batch in batches:
        for s, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(s, []).append(rest)
    while held:
        key, doc, start, size, data = joined(held.popitem()[1])
        found = covered(doc, size, data)
        if found:
            run, a, b = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(key[run]), pa.array(start[run] + a), pa.array(start[run] + b)], names=["key", "a", "b"])


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _remove(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        rows = []
        for t, ranges in zip(batch.column(2), batch.column(1)):
            raw = t.as_buffer().to_pybytes()
            gone = merged([(r["a"], r["b"]) for r in ranges.as_py()])
            kept, at = [], 0
            for a, b in gone:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            kept = b"".join(kept)
            rows.append((len(raw) - len(kept), len(gone), sha256(kept).hexdigest(), kept))
        cols = list(zip(*rows)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["key", "n_removed", "n_spans", "kept_sha256", "kept"])


#: Runs of several texts that belong to one slice, packed.
PIECES = "slice int, n int, n_bytes long, keys binary, docs binary, starts binary, sizes binary, data binary"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, doc, text. ``doc`` is the doc_id (null: the smallest number), by which documents are compared. ``key`` only tells
    texts apart: it is ``doc`` too, or, if documents with different texts share one, a number for each (doc_id, digest of the text)."""
    digest, doc = F.md5(blank("text")), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ids = docs.select("doc_id", digest.alias("digest")).distinct()
    clashes = cut(ids.groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1"), "clashes")
    if clashes.isEmpty():
        return docs.select("doc_id", doc.alias("key"), doc.alias("doc"), blank("text").alias("text"))
    numbers = cut(ids.withColumn("key", F.monotonically_increasing_id()), "keys")
    same = F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (digest == F.col("o.digest"))
    both = docs.select("doc_id", "text").alias("d").join(numbers.alias("o"), same).select("d.doc_id", "o.key", blank("d.text").alias("text"))
    return both.select("doc_id", "key", doc.alias("doc"), "text")


def removals(rows: DataFrame) -> DataFrame:
    """key, n_removed, n_spans, kept_sha256, kept (bytes) for the rows (key, doc, text) that lose something."""
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(LEAST_SLICES, SLICES_PER_PARTITION * partitions)
    texts = rows.select("key", "doc", "text")
    blocks = texts.mapInArrow(_starts_of(slices), "slice int, n int, high binary, keys binary, docs binary, starts binary")
    some = blocks.repartition(slices, "slice").mapInArrow(_shared, "key long, starts binary")
    wanted = cut(some.groupBy("key").agg(F.collect_list("starts").alias("starts")), "starts")
    # only texts with such runs move; their keys are broadcast if they fit the bound
    there = texts.join(sized(wanted.select("key"), 16), "key", "left_semi")
    pieces = wanted.join(there, "key").select("key", "doc", "starts", "text").mapInArrow(_bytes_of(slices), PIECES)
    found = pieces.repartition(slices, "slice").mapInArrow(_scan, "key long, a long, b long")
    return without(texts, found)


def without(texts: DataFrame, found: DataFrame) -> DataFrame:
    """key, n_removed, n_spans, kept_sha256, kept (bytes) for the texts (key, text) of which ``found`` (key, a, b) names ranges."""
    ranges = cut(found.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "ranges")
    there = texts.select("key", "text").join(sized(ranges.select("key"), 16), "key", "left_semi").dropDuplicates(["key"])
    return ranges.join(there, "key").select("key", "ranges", "text").mapInArrow(_remove, "key long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``kept``, the bytes that stay (a cut can split a character)."""
    rows = keyed(docs)
    lost = removals(rows).select("key", "kept")
    return rows.join(lost, "key", "left").select("doc_id", F.coalesce("kept", F.col("text").cast("binary")).alias("kept"))


def removal_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    doc_id is an integer. Null text is empty and texts below 50 bytes keep everything. Rows of one doc_id, repeated or with
    different texts, don't remove from each other; null doc_id counts as smaller than all. An empty table gives no rows; further
    columns aren't looked at.
    """
    rows = keyed(docs)
    return report(rows, cut(removals(rows).drop("kept"), "lost"))


def report(rows: DataFrame, lost: DataFrame) -> DataFrame:
    """What ``removal_report`` gives, for ``rows`` as keyed and what those that lose something lose."""
    every = rows.select("doc_id", "key", byte_length("text").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    none = F.lit(0).cast("long")
    return every.join(lost, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS s
  FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - {LENGTH - 1})) AS i FROM d WHERE length(h) >= {2 * LENGTH})),
f AS (SELECT s, min(doc_id) AS lead FROM w GROUP BY s),
c AS (SELECT w.doc_id, w.i FROM w JOIN f USING (s) WHERE f.lead < w.doc_id),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM c),
r AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
