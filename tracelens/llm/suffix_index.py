"""4 Suffix-array dedup, corpus in batches: a stored logarithmic family of suffix arrays.

Each appended batch of documents becomes a level: for each slice of the minimizers the bytes of its different runs, the places of
its different 50-byte strings in sorted order (the suffix array), and the smallest doc_id of each. The strings of the batch are
merge-scanned against every level, its own included; a string goes if it also starts in a document with a smaller doc_id, of this
batch or an earlier one. After that the newest levels are merged while one has less than twice the strings of the next, so there
are logarithmically many levels and a string is rewritten logarithmically often.

A level is a Parquet table in the folder of the index, a row a slice. The number of slices is fixed when an index is made, from
the bytes that it shall hold (``slices_for``), so that a task holds a slice of about ``SLICE_BYTES`` of a level at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import cut, discard
from tracelens.llm.suffix import LENGTH, PIECES, _bytes_of, _pack, _unpack, joined, keyed, report, without

#: Bytes of runs that a slice of the full index has, about; runs overlap, so they take RUN_BYTES bytes for each byte of text.
SLICE_BYTES, RUN_BYTES = 8 << 20, 4
LEVEL = "slice int, n int, n_bytes long, places binary, owners binary, pool binary"
_LAST = np.iinfo(np.int64).max


def slices_for(n_bytes: int) -> int:
    """Slices of an index over texts of so many bytes."""
    return max(8, -(-n_bytes * RUN_BYTES // SLICE_BYTES))


def _strings(pool: bytes, places: np.ndarray) -> np.ndarray:
    if not len(places):
        return np.zeros(0, f"S{LENGTH}")
    return np.ndarray((len(pool) - LENGTH + 1,), f"S{LENGTH}", buffer=pool, strides=(1,))[places]


def _places(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, place in the run, place in the pool) of all strings of runs that stand one after another."""
    strings = size - LENGTH + 1
    run = np.repeat(np.arange(len(size)), strings)
    inside = np.arange(len(run)) - (np.cumsum(strings) - strings)[run]
    return run, inside, (np.cumsum(size) - size)[run] + inside


def _heads(ranked: np.ndarray) -> np.ndarray:
    """Which of sorted strings differ from the one before."""
    return np.concatenate([[True], ranked[1:] != ranked[:-1]])


def _row(number: int, pool: bytes, places: np.ndarray, owners: np.ndarray):
    """A slice of a level: strings are sorted, of equal ones the smallest owner stays, bytes that no string needs go."""
    import pyarrow as pa

    strings = _strings(pool, places)
    order = np.argsort(strings, kind="stable")  # sorted runs, as those of merged levels are, are merged
    head = np.flatnonzero(_heads(strings[order]))
    places, owners = places[order][head], np.minimum.reduceat(owners[order], head)
    edges = np.bincount(places, minlength=len(pool) + 1) - np.bincount(places + LENGTH, minlength=len(pool) + 1)
    used = np.cumsum(edges)[:-1] > 0
    kept, places = np.frombuffer(pool, np.uint8)[used].tobytes(), (np.cumsum(used) - 1)[places]
    columns = (number, len(places), len(kept), _pack(places.astype(np.uint32)), _pack(owners), pa.compress(kept, codec="zstd", asbytes=True))
    kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3)
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], names=["slice", "n", "n_bytes", "places", "owners", "pool"])


def _level(n: int, n_bytes: int, places: bytes, owners: bytes, pool: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    import pyarrow as pa

    return pa.decompress(pool, n_bytes, codec="zstd", asbytes=True), _unpack(places, np.uint32, n).astype(np.int64), _unpack(owners, np.int64, n)


def _by_number(batches: Iterator) -> Iterator[tuple[int, list]]:
    """(slice, its rows) of rows that lie by slice: one slice is held at a time."""
    now, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            number, *rest = (c[i].as_py() for c in batch.columns)
            if held and number != now:
                yield now, held
                held = []
            now = number
            held.append(rest)
    if held:
        yield now, held


def _build(batches: Iterator) -> Iterator:
    """A level of the runs of a batch; runs that are equal as a whole are taken once."""
    for number, parts in _by_number(batches):
        _, doc, _, size, data = joined(parts)
        ends, first = np.cumsum(size), {}
        for a, b, d in zip((ends - size).tolist(), ends.tolist(), doc.tolist()):
            first.setdefault(data[a:b], d)  # docs ascend
        run, _, places = _places(np.array([len(r) for r in first], np.int64))
        yield _row(number, b"".join(first), places, np.array(list(first.values()), np.int64)[run])


def _merge(batches: Iterator) -> Iterator:
    """One level of several."""
    for number, parts in _by_number(batches):
        pools, places, owners = zip(*(_level(*p) for p in parts))
        begin = np.cumsum([0, *map(len, pools)])
        yield _row(number, b"".join(pools), np.concatenate([p + b for p, b in zip(places, begin)]), np.concatenate(owners))


def _matches(batches: Iterator) -> Iterator:
    """(key, from, to) for the byte ranges of a batch's runs whose strings some level has under a smaller doc_id."""
    import pyarrow as pa

    for _, rows in _by_number(batches):
        pieces, levels = [r[1:] for r in rows if r[0] == 0], [r[1:] for r in rows if r[0] > 0]
        if not pieces:
            continue
        key, doc, start, size, data = joined(pieces)
        run, inside, places = _places(size)
        strings = _strings(data, places)
        order = np.argsort(strings, kind="stable")
        strings = strings[order]
        head = _heads(strings)
        group, kinds = np.cumsum(head) - 1, strings[head]
        least = np.full(len(kinds), _LAST)
        for n, n_bytes, _, owners, at, _, pool in levels:
            pool, at, owners = _level(n, n_bytes, at, owners, pool)
            both = np.concatenate([kinds, _strings(pool, at)])
            rank = np.argsort(both, kind="stable")  # two sorted runs: a merge, in which the batch's string stands before its equal
            both = both[rank]
            same = np.flatnonzero(both[1:] == both[:-1])
            mine = rank[same]
            least[mine] = np.minimum(least[mine], owners[rank[same + 1] - len(kinds)])
        hit = np.zeros(len(places), bool)
        hit[order] = least[group] < doc[run][order]
        fresh = run[1:] != run[:-1]
        first = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | fresh]))
        last = np.flatnonzero(hit & np.concatenate([~hit[1:] | fresh, [True]]))
        if len(first):
            begin, ids = start[run], key[run]
            out = (ids[first], (begin + inside)[first], (begin + inside)[last] + LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["key", "a", "b"])


class Index:
    """A stored family of suffix arrays.

    ``folder`` must be one that the driver and all executors share. ``expected_bytes``, of all texts that will be appended, sets the
    number of slices of a new index; an index that is there keeps its own. The levels are named by the newest ``state`` table, which
    is written last: an append that fails leaves the index as it was, and to append documents again changes no result. One append at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, expected_bytes: int = 0):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.number, self.slices, self.levels = 0, slices_for(expected_bytes), []
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state-*/_SUCCESS")
        there = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path) or []
        if names := [str(x.getPath().getParent().getName()) for x in there]:
            self.number = max(int(name.rpartition("-")[2]) for name in names)
            rows = spark.read.parquet(f"{self.folder}/state-{self.number}").orderBy("place").collect()
            self.slices, self.levels = rows[0]["slices"], [(r["name"], r["strings"]) for r in rows if r["name"]]

    def _read(self, name: str) -> DataFrame:
        out = self.spark.read.schema(LEVEL).parquet(f"{self.folder}/{name}")
        out.cut_path = f"{self.folder}/{name}"
        return out

    def _sliced(self, df: DataFrame, *order: str) -> DataFrame:
        return df.repartition(self.slices, "slice").sortWithinPartitions("slice", *order)

    def _write(self, df: DataFrame, made) -> tuple[str, int]:
        name = f"level-{uuid.uuid4().hex}"
        self._sliced(df).mapInArrow(made, LEVEL).write.parquet(f"{self.folder}/{name}")
        return name, self._read(name).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    def append(self, docs: DataFrame) -> DataFrame:
        """Adds ``docs`` (doc_id, text) to the index. Per row of them: doc_id, n_bytes, n_removed, n_spans, kept_sha256, as
        ``suffix.removal_report`` gives them for all documents so far.

        So batches whose doc_ids ascend give together what one call gives; a document that comes later with a smaller doc_id than
        one in the index takes nothing from that one any more, as its result is out. Null texts are empty, null doc_ids are smaller
        than all; rows of one doc_id, in whatever batches, don't remove from each other. An empty batch adds no level.
        """
        rows = keyed(docs)
        texts = rows.select("key", "doc", F.lit(None).cast("array<binary>").alias("starts"), "text")
        pieces = cut(texts.mapInArrow(_bytes_of(self.slices, every=True), PIECES), "pieces")
        levels, old = list(self.levels), []
        name, strings = self._write(pieces, _build)
        if strings:
            levels.append((name, strings))
        else:
            old.append(self._read(name))
        both = pieces.select("slice", F.lit(0).alias("level"), *pieces.columns[1:])
        for i, (name, _) in enumerate(levels):
            as_pieces = [F.lit(None).cast("binary").alias("keys"), F.col("owners").alias("docs"), F.col("places").alias("starts"), F.lit(None).cast("binary").alias("sizes"), F.col("pool").alias("data")]
            both = both.union(self._read(name).select("slice", F.lit(i + 1).alias("level"), "n", "n_bytes", *as_pieces))
        found = self._sliced(both, "level").mapInArrow(_matches, "key long, a long, b long")
        lost = cut(without(texts, found).drop("kept"), "lost")
        while len(levels) > 1 and levels[-2][1] < 2 * levels[-1][1]:
            pair = [self._read(name) for name, _ in levels[-2:]]
            levels[-2:] = [self._write(pair[0].union(pair[1]), _merge)]
            old += pair
        self._save(levels)
        discard(pieces, *old)
        return report(rows, lost)

    def _save(self, levels: list[tuple[str, int]]) -> None:
        rows = [(i, self.slices, *x) for i, x in enumerate(levels)] or [(0, self.slices, None, 0)]
        self.spark.createDataFrame(rows, "place int, slices int, name string, strings long").coalesce(1).write.parquet(f"{self.folder}/state-{self.number + 1}")
        self.number, self.levels = self.number + 1, levels
