"""7 Best-fit packing: a linear grouping scheme.

Every document becomes token ids and an end id; only longer ones are cut, so that all pieces but the first are
full. Full pieces are sequences of their own. What is left is a histogram of lengths below the capacity, at most
``capacity - 1`` counts however large the corpus is. On it the driver plans: lengths above ``SMALL`` are sorted and
put in groups of nearly equal counts, each rounded up to the largest of its group; configurations of the
few rounded sizes are filled (the best completion that a search of up to 20,000 steps finds, repeated while it can be); the rounded
items become actual lengths again, largest first; lengths that come out with slack are then filled best-fit with the small ones.
The plan says how many sequences have which lengths. Documents are substituted by their rank among those of equal length,
which is a prefix sum over counts, so no task sees more than its share of the rows.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelens.llm.common import blank, cut, table

CAPACITY, END_ID = 1024, 2
TOKENIZER = "byte_bpe_50k.json"
#: Lengths up to this are left for the best-fit step.
SMALL = 64
#: Groups of the linear grouping; more groups round less and plan longer.
GROUPS = 256
#: Buckets in which pieces of one length are ranked: full pieces, which are most, and those of any other length.
FULL_BUCKETS, BUCKETS = 4096, 16
PIECES = "piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the
    others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def id_encoder(path: str) -> Callable[[str], bytes]:
    """Text to ids as little-endian unsigned 32-bit bytes, those that the tokenizers library gives.

    A plain byte-level BPE whose merges are in the order of their ids (both are checked in the file) is run by
    tiktoken, which is several times faster and gives the same ids; texts with an added token's string, and
    all texts under any other kind of file, go to the tokenizers library itself.
    """
    import numpy as np
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    with open(path) as f:
        spec = json.load(f)
    whole = lambda text: np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", ())
    vocab, merges = spec["model"].get("vocab", {}), spec["model"].get("merges", ())
    plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or any(vocab.get("".join(m if isinstance(m, list) else m.split(" "))) != 256 + i for i, m in enumerate(merges)):
        return whole
    of, strings = byte_characters(), [t["content"] for t in added]
    ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in strings}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def run(text: str) -> bytes:
        if any(t in text for t in strings):
            return whole(text)
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    return run


def pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc) of a document's id bytes: the first piece takes what doesn't fill one."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    start, k = 0, 0
    while start < n:
        stop = first if k == 0 else start + capacity
        yield k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])
        start, k = stop, k + 1


def _cutter(path: str, capacity: int, end_id: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, end = id_encoder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1)):
                for row in pieces(encode(t.as_py()) + end, capacity):
                    at.append(i)
                    rows.append(row)
            cols = list(zip(*rows)) or [()] * 4
            kinds = [pa.int32()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


# ---- the plan, on the histogram alone


def linear_groups(counts: dict[int, int], n_groups: int = GROUPS) -> list[list[int]]:
    """Distinct lengths, ascending, in groups of nearly equal numbers of documents."""
    total, groups, held = sum(counts.values()), [[]], 0
    for length in sorted(counts):
        if groups[-1] and held + counts[length] > total / n_groups:
            groups.append([])
            held = 0
        groups[-1].append(length)
        held += counts[length]
    return [g for g in groups if g]


def best_completion(sizes: list[int], left: list[int], room: int) -> list[int]:
    """How many of each size (descending) fill ``room`` best; depth-first, larger sizes first, stops at a perfect fill."""
    best: tuple[int, list[int]] = (room, [0] * len(sizes))
    take = [0] * len(sizes)
    steps = 0

    def go(i: int, room: int) -> bool:
        nonlocal best, steps
        steps += 1
        if room < best[0]:
            best = (room, take.copy())
        if room == 0 or steps > 20_000:
            return True
        for k in range(i, len(sizes)):
            if sizes[k] <= room and take[k] < left[k]:
                take[k] += 1
                done = go(k, room - sizes[k])
                take[k] -= 1
                if done:
                    return True
        return False

    go(0, room)
    return best[1]


def plan(counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, n_groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use up ``counts`` exactly."""
    out: Counter = Counter()
    if counts.get(capacity):
        out[(capacity,)] = counts[capacity]
    large = {k: v for k, v in counts.items() if small < k < capacity and v}
    groups = linear_groups(large, n_groups)[::-1]
    sizes, left = [g[-1] for g in groups], [sum(large[x] for x in g) for g in groups]
    pool = [[[x, large[x]] for x in g] for g in groups]  # actual lengths of a group, ascending
    open_: Counter = Counter()
    while any(left):
        first = next(i for i, n in enumerate(left) if n)
        left[first] -= 1
        shape = best_completion(sizes, left, capacity - sizes[first])
        left[first] += 1
        shape[first] += 1
        times = min(left[i] // k for i, k in enumerate(shape) if k)
        for i, k in enumerate(shape):
            left[i] -= k * times
        while times:  # actual lengths, largest first; runs of the same lengths are taken together
            picked, take = [], Counter()
            for i, k in enumerate(shape):
                for _ in range(k):
                    j = next(j for j in range(len(pool[i]) - 1, -1, -1) if pool[i][j][1] > take[i, j])
                    take[i, j] += 1
                    picked.append(pool[i][j][0])
            run = min(times, *(pool[i][j][1] // n for (i, j), n in take.items()))
            for (i, j), n in take.items():
                pool[i][j][1] -= n * run
            for i in {i for i, _ in take}:
                pool[i] = [x for x in pool[i] if x[1]]
            open_[tuple(picked)] += run
            times -= run
    return out, open_


def fill_small(out: Counter, open_: Counter, counts: dict[int, int], capacity: int, small: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit: each small length, from the largest, goes to the fullest sequence that still takes it."""
    rooms: dict[int, list] = {}
    for lengths, n in open_.items():
        rooms.setdefault(capacity - sum(lengths), []).append([lengths, n])
    keys = sorted(rooms)
    for length in sorted((k for k, v in counts.items() if k <= small and v), reverse=True):
        n = counts[length]
        while n:
            i = bisect_right(keys, length - 1)
            if i == len(keys):
                fit = capacity // length
                times, rest = divmod(n, fit)
                new = [((length,) * fit, times)] * bool(times) + [((length,) * rest, 1)] * bool(rest)
                n = 0
                room_now = [(capacity - sum(x), x, k) for x, k in new]
            else:
                room = keys[i]
                lengths, have = rooms[room].pop()
                fit = room // length
                times = min(have, -(-n // fit))
                used = [(fit, times)] if fit * times <= n else [(fit, times - 1), (n - fit * (times - 1), 1)]
                if have > times:
                    rooms[room].append([lengths, have - times])
                room_now = [(room - length * f, lengths + (length,) * f, k) for f, k in used if k]
                n -= sum(f * k for f, k in used)
                if not rooms[room]:
                    del rooms[room]
                    keys.pop(i)
            for room, lengths, k in room_now:
                if room not in rooms:
                    rooms[room] = []
                    insort(keys, room)
                rooms[room].append([lengths, k])
    for group in rooms.values():
        for lengths, n in group:
            out[lengths] += n
    return sorted(out.items(), reverse=True)


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, n_groups: int = GROUPS):
    out, open_ = plan(counts, capacity, small, n_groups)
    return fill_small(out, open_, counts, capacity, small)


def slots(shapes: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each shape and length in it: (length, first rank, ranks, copies in a sequence, first sequence_id, offset of the first copy)."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for lengths, n in shapes:
        offset = 0
        for length, copies in Counter(lengths).items():
            rows.append((length, rank[length], copies * n, copies, sequence, offset))
            rank[length] += copies * n
            offset += length * copies
        sequence += n
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of each row of ``docs``.

    Null text is empty: one piece that holds the end id. Repeated rows are packed each for itself. An empty table
    gives no rows. Sequence numbers run from 0; those of full pieces come first.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    path = path or tokenizer_path()
    rows = docs.select("doc_id", blank("text").alias("text")).mapInArrow(_cutter(path, capacity, end_id), f"doc_id {kind}, {PIECES}")
    rows = cut(rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.when(F.col("length") == capacity, FULL_BUCKETS).otherwise(BUCKETS)).cast("int")), "pieces")
    held = rows.groupBy("length", "_bucket").count().collect()  # at most FULL_BUCKETS + capacity x BUCKETS numbers
    counts: Counter = Counter()
    before = []
    for length, bucket, n in sorted(map(tuple, held)):
        before.append((length, bucket, counts[length]))
        counts[length] += n
    shapes = pack_histogram(dict(counts), capacity)
    offsets = spark.createDataFrame(before or [(0, 0, 0)], "length long, _bucket int, _before long")
    own = W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("_in", F.row_number().over(own) - 1).join(F.broadcast(offsets), ["length", "_bucket"])
    ranked = ranked.withColumn("rank", F.col("_before") + F.col("_in"))
    # intervals of ranks for each length, sorted: an array to search in, one row per length
    by_length: dict[int, list] = {}
    for length, *rest in slots(shapes):
        by_length.setdefault(length, []).append(tuple(rest))
    kind_of = "length long, plan array<struct<rank:long,ranks:long,copies:long,sequence:long,offset:long>>"
    plans = spark.createDataFrame(list(by_length.items()) or [(0, [])], kind_of)
    each = plans.select("length", F.explode("plan").alias("p")).select("length", "p.*")
    found = ranked.alias("r").join(
        F.broadcast(each.alias("e")), (F.col("r.length") == F.col("e.length")) & (F.col("r.rank") >= F.col("e.rank")) & (F.col("r.rank") < F.col("e.rank") + F.col("e.ranks"))
    )
    k = F.col("r.rank") - F.col("e.rank")
    return found.select(
        "doc_id", "piece", "start", F.col("r.length").alias("length"), "ids_crc32",
        (F.col("e.sequence") + F.floor(k / F.col("e.copies"))).cast("long").alias("sequence_id"),
        (F.col("e.offset") + F.pmod(k, F.col("e.copies")) * F.col("r.length")).cast("long").alias("offset"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
