"""Event traces as DataFrames: binary files, zip archives with one inside, JSON lines or Parquet of events, and growing files as streams.

A large binary trace is read in parallel. Messages say their length only at their start, so a first pass over message headers finds where
messages begin in each split of the file: a split guesses its first message from what headers look like, and the guess counts only if
the messages of the splits before lead up to it. Then the number of messages before each split is known, and splits are decoded for themselves.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tracelens.model import EVENTS
from tracelens.sources import capnp

#: Events in a batch; bytes of a split, which is what a task holds in memory.
ROWS, SPLIT = 5000, 64 << 20
#: Bytes read beyond a split for the header of its last message, and segments that such a header can have.
MARGIN, MAX_SEGMENTS = 8192, 1000


def located(path: str):
    """(file system, path within it) of a local path or a URI of any store that pyarrow reads."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file or of all files in a folder, by name."""
    from pyarrow import fs

    store, at = located(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
    return [(path if len(found) == 1 and info.type == fs.FileType.File else f"{path.rstrip('/')}/{x.base_name}", x.size) for x in sorted(found, key=lambda x: x.base_name)]


def part_of(path: str, lo: int, hi: int) -> bytes:
    """Bytes lo to hi; fewer if the file ends before."""
    store, at = located(path)
    with store.open_input_file(at) as f:
        f.seek(lo)
        return f.read(hi - lo)


def is_zip(path: str) -> bool:
    return part_of(path, 0, 4) == b"PK\x03\x04"


def unzipped(path: str):
    """A stream of the first entry named ``tracefile`` of a zip archive."""
    store, at = located(path)
    archive = zipfile.ZipFile(store.open_input_file(at))
    for name in archive.namelist():
        if name == "tracefile" or name.endswith("/tracefile"):
            return archive.open(name)
    raise FileNotFoundError(f"no tracefile in {path}")


def length_at(data: bytes, at: int) -> int | None:
    """Bytes of the message whose header is at ``at``; None if the header isn't whole or can't be one."""
    if at + 8 > len(data):
        return None
    (n,) = struct.unpack_from("<I", data, at)
    n += 1
    head = 4 * (1 + n + (n + 1) % 2)
    if n > MAX_SEGMENTS or at + head > len(data):
        return None
    return head + 8 * sum(struct.unpack_from(f"<{n}I", data, at + 4))


def looks_like_event(data: bytes, at: int) -> bool:
    """Whether a message of one segment seems to be at ``at`` whose root has one word, for a known kind, and one pointer."""
    if at + 24 > len(data):
        return False
    one, words, root, kind = struct.unpack_from("<IIQQ", data, at)
    return one == 0 and 3 <= words and root == (1 << 32 | 1 << 48) and kind < len(capnp.KINDS)


def walked(data: bytes, at: int, hi: int, left: int, check: bool = False) -> tuple[int, int] | None:
    """(where the first message at or after ``hi`` begins, messages before it), from the message at ``at``; ``left`` bytes of the file are from the
    start of ``data`` on. A message that the file breaks off in, and what can't be one, is not counted: the end is where it begins. None if
    ``check`` is asked for and some message doesn't look like an event."""
    n = 0
    while at < hi:
        if check and at + 24 <= len(data) and not looks_like_event(data, at):
            return None
        size = length_at(data, at)
        if size is None or at + size > left:
            break
        at, n = at + size, n + 1
    return at, n


def searched(path: str, lo: int, hi: int, size: int, start: int | None = None) -> tuple[int, int, int]:
    """(start, end, messages) of a split: its messages begin within it. Without a known ``start`` it is the first place from which all headers
    look like events; -1 if there is none."""
    data = part_of(path, lo, min(hi + MARGIN, size))
    if start is not None:
        end, n = walked(data, start - lo, hi - lo, size - lo)
        return start, lo + end, n
    root = struct.pack("<Q", 1 << 32 | 1 << 48)
    at = data.find(root) - 8
    while 0 <= at < hi - lo:
        if at % 8 == 0 and looks_like_event(data, at) and (found := walked(data, at, hi - lo, size - lo, check=True)):
            return lo + at, lo + found[0], found[1]
        at = data.find(root, at + 9) - 8
    return -1, -1, 0


def ranges_of(spark: SparkSession, path: str, size: int, split: int = SPLIT) -> list[tuple[int, int, int]]:
    """(first byte, end, idx of the first message) of the ranges of one plain file; the driver sees three numbers a split."""
    split = max(8, split - split % 8)  # messages begin at multiples of 8
    cuts = [(lo, min(lo + split, size)) for lo in range(0, size, split)]

    def search(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(r["lo"], *searched(path, r["lo"], r["hi"], size, r["start"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["lo", "start", "end", "n"])

    def ask(rows):
        df = spark.createDataFrame(rows, "lo long, hi long, start long").repartition(len(rows))
        return {r["lo"]: (r["start"], r["end"], r["n"]) for r in df.mapInArrow(search, "lo long, start long, end long, n long").collect()}

    found, out, at, idx = ask([(lo, hi, 0 if lo == 0 else None) for lo, hi in cuts]) if cuts else {}, [], 0, 1
    for lo, hi in cuts:
        if at >= hi:
            continue  # one message covers all of the split
        start, end, n = found[lo]
        if start != at:  # the guess was wrong: now it is known where the messages begin
            start, end, n = ask([(lo, hi, at)])[lo]
        if n:
            out.append((at, end, idx))
        if end < hi:
            break  # the file breaks off here
        at, idx = end, idx + n
    return out


def row(idx: int, kind: str, fields: dict) -> dict:
    return {"idx": idx, "kind": kind, kind: fields}


def decoded(stream, first: int, schema) -> Iterator:
    """Arrow batches of the events of a binary stream."""
    import pyarrow as pa

    rows = []
    for idx, kind, fields in capnp.events(stream, first):
        rows.append(row(idx, kind, fields))
        if len(rows) == ROWS:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def range_batches(path: str, lo: int, hi: int, first: int, schema) -> Iterator:
    """Events of a range; ``hi`` -1 stands for a whole zip archive, which is decoded as a stream."""
    yield from decoded(unzipped(path) if hi < 0 else io.BytesIO(part_of(path, lo, hi)), first, schema)


def read_trace(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Events of a binary trace file, or of the files of a folder; idx counts from 1 in each file. Plain files of any size are decoded in parallel
    ranges, zip archives as a stream by one task each. A trace that breaks off inside a message ends there."""
    ranges = []
    for file, size in files_of(path):
        ranges += [(file, 0, -1, 1)] if is_zip(file) else [(file, *r) for r in ranges_of(spark, file, size, split)]
    schema = arrow_schema_of_events()

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from range_batches(r["path"], r["lo"], r["hi"], r["first"], schema)

    rows = spark.createDataFrame(ranges, "path string, lo long, hi long, first long")
    return (rows.repartition(len(ranges)) if ranges else rows).mapInArrow(run, EVENTS)


def arrow_schema_of_events():
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(EVENTS)


def read_events(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Events in the interchange forms: Parquet, or JSON lines."""
    return spark.read.schema(EVENTS).format(format).load(path)


class TraceDataSource(DataSource):
    """``spark.read.format("trace").load(path)``, a task for each file; ``read_trace`` reads one large file in parallel.

    ``spark.readStream.format("trace").load(path)`` follows a plain file that grows: each batch has the messages that are whole by then. Offsets
    are bytes and messages, so a restart goes on where the last batch ended. Option ``split``: bytes of a task."""

    @classmethod
    def name(cls):
        return "trace"

    def schema(self):
        return EVENTS

    def reader(self, schema):
        return TraceReader(self.options)

    def streamReader(self, schema):
        return TraceStream(self.options)


class TraceReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for path in (options.get("path") and [options["path"]] or json.loads(options["paths"])) for p, _ in files_of(path)]
        self.schema = arrow_schema_of_events()

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        store, at = located(partition.value)
        if is_zip(partition.value):
            yield from range_batches(partition.value, 0, -1, 1, self.schema)
        else:
            with store.open_input_file(at) as f:
                yield from decoded(f, 1, self.schema)


class TraceStream(DataSourceStreamReader):
    """Offsets: {"at": byte where the next message begins, "idx": its number}."""

    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.known = self.initialOffset()
        self.schema = arrow_schema_of_events()

    def initialOffset(self):
        return {"at": 0, "idx": 1}

    def _on(self, offset: dict, end: int) -> Iterator[dict]:
        """The offsets after each split of up to ``end``; a message that isn't whole yet is left for later."""
        while offset["at"] < end:
            hi = min(offset["at"] + self.split, end)
            _, at, n = searched(self.path, offset["at"], hi, end, offset["at"])
            if not n:
                return
            offset = {"at": at, "idx": offset["idx"] + n}
            yield offset

    def latestOffset(self):
        from pyarrow import fs

        store, at = located(self.path)
        info = store.get_file_info(at)
        for offset in self._on(self.known, info.size if info.type == fs.FileType.File else 0):
            self.known = offset
        return self.known

    def partitions(self, start, end):
        out, now = [], start
        for offset in self._on(start, end["at"]):
            out.append(InputPartition((now["at"], offset["at"], now["idx"])))
            now = offset
        return out

    def commit(self, end):
        if end["at"] > self.known["at"]:
            self.known = end

    def read(self, partition):
        lo, hi, first = partition.value
        yield from range_batches(self.path, lo, hi, first, self.schema)


def write_trace(events: list[tuple[str, dict]], path: str) -> None:
    """A small binary trace from (kind, fields) pairs, in order."""
    with open(path, "wb") as f:
        f.writelines(capnp.encode(kind, fields) for kind, fields in events)


def read_class_files(spark: SparkSession, folder: str) -> DataFrame:
    """classname (a.b.C), bytecode: every file below ``folder``/input."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder.rstrip('/')}/input")
    name = F.regexp_replace(F.regexp_extract("path", r"/input/(.*)$", 1), r"\.class$", "")
    return files.select(F.translate(name, "/", ".").alias("classname"), F.col("content").alias("bytecode"))
