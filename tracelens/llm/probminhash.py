"""3 MinHash near-dedup by ProbMinHash.

A text's shingles of five words are weighted by how often they occur. Each shingle sends arrivals of a Poisson
process whose rate is its weight to random registers; a register keeps its earliest arrival. A shingle stops
as soon as its next arrival is later than all registers hold (early termination), which changes no
register. Two texts agree in a register with their probability Jaccard similarity as probability. Registers are cut
in bands; texts that agree in a band are candidates and are verified by the exact probability Jaccard.

Equal texts are one node. In a bucket of a band every node is compared to a few leaders, not to all; links give
components; then only pairs of a bucket that are still in different components are looked at. A bitmap of the shingles bounds
how similar two texts can be and rules most of these pairs out before their texts are fetched, and never one that is a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import blank, cut, discard, sized, table
from tracelens.llm.components import crowd, linked

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair is missed with probability (1 - 0.8**ROWS)**BANDS = 0.0004.
BANDS, ROWS = 20, 5
BLOCK_BYTES = 2_000_000
#: Longs of the bitmap that bounds how much two shingle sets can share.
MASKS = 16
SEED = 0x9E3779B97F4A7C15

_FOLD = np.zeros(256, np.uint8)  # 0: not in a word; A-Z fold to a-z; bytes from 128 on are in words
for _b in range(256):
    if _b >= 128 or 48 <= _b <= 57 or 97 <= _b <= 122:
        _FOLD[_b] = _b
    elif 65 <= _b <= 90:
        _FOLD[_b] = _b + 32
_BASE = np.uint64(0x100000001B3)
_UNBASE = np.uint64(pow(0x100000001B3, -1, 1 << 64))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x ^ np.uint64(salt & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts that lie in ``raw`` one after another, and where each word begins.
    ``starts``: first bytes of the texts. Works in blocks that end between words, so memory follows the block."""
    begin = np.zeros(len(raw) + 1, bool)
    begin[starts] = True
    hashes, places, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK_BYTES)
        block = _FOLD[np.frombuffer(raw, np.uint8, end - at, at)]
        if end < len(raw):
            gaps = np.flatnonzero((block == 0) | begin[at:end])
            if len(gaps) and gaps[-1] > 0:
                end = at + int(gaps[-1])
                block = block[: end - at]
        n = len(block)
        word = block != 0
        before = np.concatenate([[False], word[:-1]])
        first = np.flatnonzero(word & (~before | begin[at:end]))
        if len(first):
            after = np.concatenate([word[1:], [False]])
            fresh = np.concatenate([begin[at + 1 : end], [True]])
            last = np.flatnonzero(word & (~after | fresh)) + 1
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)
            sums = np.concatenate([[np.uint64(0)], np.cumsum((block.astype(np.uint64) + np.uint64(1)) * powers * word, dtype=np.uint64)])
            back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _UNBASE)]), dtype=np.uint64)
            hashes.append(mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64)))
            places.append(first + at)
        at = end
    empty = np.zeros(0, np.int64)
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (empty.astype(np.uint64), empty)


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, weight), sorted by text and hash. A text of fewer words, but not none, is one shingle."""
    starts = np.cumsum([0] + [len(t) for t in texts])
    words, places = word_hashes(b"".join(texts), starts[:-1][np.diff(starts) > 0])
    text = np.searchsorted(starts, places, "right") - 1
    count = np.bincount(text, minlength=len(texts))
    with np.errstate(over="ignore"):
        total = np.zeros(max(len(words) - size + 1, 0), np.uint64)
        for k in range(size):
            total = mix(total + words[k : len(words) - size + 1 + k], SEED + k)
    ok = text[: len(total)] == text[size - 1 :] if len(total) else np.zeros(0, bool)
    owner, hashes = text[: len(total)][ok], total[ok]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(text, short)
        own = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size - 1):
                on = count[short] > k
                own[on] = mix(own[on] + words[first[on] + k], SEED + 99 + k)
        owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, own])
    if not len(owner):
        return owner, hashes, np.zeros(0)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(owner))).astype(float)


def registers(n: int, owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """n x m register contents: the shingle hash of the earliest arrival (0 where a text has no shingles)."""
    when, what = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    t, j = np.zeros(len(owner)), 0
    while len(owner):
        with np.errstate(over="ignore"):
            draw = mix(hashes, SEED * (2 * j + 1))
            place = owner * m + (mix(hashes, SEED * (2 * j + 2)) % np.uint64(m)).astype(np.int64)
        # uniform in (0, 1] to a standard exponential, over the rate
        t = t - np.log(((draw >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / weights
        np.minimum.at(when, place, t)
        won = when[place] == t
        what[place[won]] = hashes[won]
        limit = when.reshape(n, m).max(axis=1)
        go = t < limit[owner]
        owner, hashes, weights, t, j = owner[go], hashes[go], weights[go], t[go], j + 1
    return what.reshape(n, m)


def bitmaps(n: int, owner: np.ndarray, hashes: np.ndarray, words: int) -> np.ndarray:
    """n x words: each shingle flips one bit. Two bitmaps differ in no more bits than the shingle sets in shingles."""
    spot = (mix(hashes, 77) % np.uint64(64 * words)).astype(np.int64)
    flips = np.bincount(owner * 64 * words + spot, minlength=n * 64 * words).astype(np.uint8) & 1
    return np.packbits(flips.reshape(n, -1), axis=1).view(np.int64).reshape(n, words)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact: the sum over shared i of 1 / sum_j max(a_j / a_i, b_j / b_i). a, b: (sorted hashes, weights)."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    shared, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    x, y = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio)
    x, y, ratio = x[order], y[order], ratio[order]
    # of the shared ones, those with a larger ratio give a_j / a_i, the others b_j / b_i
    over = np.searchsorted(ratio, ratio, "right")
    cum_x, cum_y = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(y)])
    return float(np.sum(1.0 / ((only_a + cum_x[-1] - cum_x[over]) / x + (only_b + cum_y[over]) / y)))


def _blocks(batch) -> Iterator:
    """Slices of an Arrow batch of about BLOCK_BYTES of text (its last column)."""
    lo, held = 0, 0
    for i, t in enumerate(batch.column(batch.num_columns - 1)):
        held += len(t.as_buffer()) if t.is_valid else 0
        if held >= BLOCK_BYTES:
            yield batch.slice(lo, i + 1 - lo)
            lo, held = i + 1, 0
    if lo < batch.num_rows:
        yield batch.slice(lo)


def _texts(column) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]


def _sign(bands: int, rows: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in _blocks(batch):
                texts = _texts(part.column(2))
                owner, hashes, weights = shingles(texts)
                regs = registers(len(texts), owner, hashes, weights, bands * rows).reshape(len(texts), bands, rows)
                key = np.zeros((len(texts), bands), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(rows):
                        key = mix(key + regs[:, :, k], SEED + k)
                    key = mix(key + np.arange(bands, dtype=np.uint64))
                some = np.bincount(owner, minlength=len(texts)) > 0
                lists = [k.tolist() if s else [] for k, s in zip(key.view(np.int64), some)]
                masks = bitmaps(len(texts), owner, hashes, MASKS)
                size = np.bincount(owner, weights, len(texts)).astype(float)  # integers where there are no shingles at all
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int64())), pa.array(size), *(pa.array(masks[:, k]) for k in range(MASKS))],
                    names=["doc_id", "node", "bands", "size", *(f"m{k}" for k in range(MASKS))])

    return run


def _verify(similarity: float):
    """A sum of fractions can come out a little below the similarity that it is."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in _blocks(batch):
                n, texts = part.num_rows, _texts(part.column(2)) + _texts(part.column(3))
                owner, hashes, weights = shingles(texts)
                cuts = np.searchsorted(owner, np.arange(2 * n + 1))
                side = lambda i: (hashes[cuts[i] : cuts[i + 1]], weights[cuts[i] : cuts[i + 1]])  # noqa: E731, B023
                ok = [probability_jaccard(side(i), side(n + i)) >= similarity - 1e-9 for i in range(n)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def _near(similarity: float):
    """No pair of at least ``similarity`` fails this. With masses A >= B, at most A + (1 - s) B is the sum of the larger
    weights of two such texts, and at most 1 - s of that is the number of shingles that only one of them has."""

    def near(u: Column, v: Column) -> Column:
        apart = sum((F.bit_count(u[f"m{k}"].bitwiseXOR(v[f"m{k}"])) for k in range(1, MASKS)), F.bit_count(u["m0"].bitwiseXOR(v["m0"])))
        larger, smaller = F.greatest(u["size"], v["size"]), F.least(u["size"], v["size"])
        return apart <= (1 - similarity) * (larger + (1 - similarity) * smaller) + 1e-6

    return near


def digest(text: str) -> Column:
    """What tells different texts apart; null counts as empty."""
    return F.unhex(F.md5(blank(text)))


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, node (the text's digest), root (one node of its class)."""
    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", digest("text").alias("node"), blank("text").alias("text"))
    signed = cut(keyed.mapInArrow(_sign(bands, rows), f"doc_id {kind}, node binary, bands array<long>, size double, " + ", ".join(f"m{k} long" for k in range(MASKS))), "signed")
    # one row per different text; which row it comes from doesn't matter, equal texts have equal bands
    masks = [f"m{k}" for k in range(MASKS)]
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("size").alias("size"), *[F.first(m).alias(m) for m in masks])
    nodes = cut(nodes, "nodes")

    def verify(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        wanted = cut(nodes.join(ids, "node", "left_semi").select("node", "doc_id"), "wanted")
        same = (F.col("d.node") == F.col("w.node")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
        texts = keyed.alias("d").join(sized(wanted, 60).alias("w"), same, "left_semi").select("node", "text")
        texts = cut(texts.dropDuplicates(["node"]), "texts")
        a, b = texts.select(F.col("node").alias("u"), F.col("text").alias("a")), texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
        return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(_verify(similarity), "u binary, v binary")

    # only nodes that share a bucket are joined to their bitmaps
    shared = crowd(nodes.select("node", F.explode("bands").alias("bucket")))
    crowded = cut(shared.join(nodes.select("node", "bands", "size", *masks), "node"), "crowded")
    discard(shared)
    # two nodes meet in the first bucket of those they share
    roots = linked(crowded, verify, _near(similarity), lambda u, v, bucket: F.array_intersect(u["bands"], v["bands"])[0] == bucket)
    discard(crowded)
    rows_of = signed.select("doc_id", "node")
    return rows_of.join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id (the smallest doc_id of its class), kept (it is that document).

    Equal texts share a class, also empty ones; null text counts as empty. Repeated rows stay; a class whose
    doc_ids are all null has a null class_id. Of rows that repeat a class's smallest doc_id all are marked kept.
    """
    labelled = classes(docs, similarity, bands, rows).select("doc_id", "root")
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return labelled.join(least, "root").select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
