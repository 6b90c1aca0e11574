"""Binary traces read in parallel ranges, and followed while they grow."""

import io
import random
import struct
import zipfile

import pytest

from tests import traces as T
from tracelens.operators import loader
from tracelens.sources import capnp, trace
from tracelens.streaming.stack import stack_rows

#: What a guess of a message's start looks for, within a text.
DECOY = (b"\x00\x00\x00\x00\x05\x00\x00\x00" + struct.pack("<QQ", 1 << 32 | 1 << 48, 2)).decode("latin-1")


def two_segments(message: bytes) -> bytes:
    """The same message behind a far pointer."""
    body = message[8:]
    return struct.pack("<IIII", 1, 1, len(body) // 8, 0) + struct.pack("<Q", 2 | 1 << 32) + body


def events(n, seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        out.append(rng.choice([
            lambda: T.enter("m" * rng.randrange(1, 60), 100 + i), lambda: T.leave("m"), lambda: T.store(100, f"f{i}", 5), lambda: T.touch(100, True), lambda: T.late(100, a=1, b=i),
            lambda: T.store(100, DECOY * rng.randrange(1, 4), 6), lambda: T.var(100, 3, i)])())
    return out


def encoded(evs, far=0):
    return [two_segments(m) if far and i % far == 0 else m for i, m in enumerate(capnp.encode(k, f) for k, f in evs)]


def read(df):
    return [(r["idx"], r["kind"], r[r["kind"]].asDict(recursive=True)) for r in df.orderBy("idx").collect()]


def plain(data):
    return list(capnp.events(io.BytesIO(data)))


@pytest.mark.parametrize("far", [0, 5, 1])
def test_ranges_in_parallel(spark, tmp_path, far):
    data = b"".join(encoded(events(300), far))
    (tmp_path / "t").write_bytes(data)
    split = len(data) // 3
    ranges = trace.ranges_of(spark, str(tmp_path / "t"), len(data), split)
    assert len(ranges) in (3, 4) and ranges[0][0] == 0 and ranges[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    df = trace.read_trace(spark, str(tmp_path / "t"), split)
    assert df.rdd.getNumPartitions() == len(ranges)
    assert read(df) == plain(data)


def test_ranges_with_tiny_splits_and_a_long_message(spark, tmp_path):
    data = b"".join(encoded([*events(20), T.enter("x" * 5000, 1), *events(20, 2)]))
    (tmp_path / "t").write_bytes(data)
    assert read(trace.read_trace(spark, str(tmp_path / "t"), 1000)) == plain(data)


@pytest.mark.parametrize("cut", [1, 8, 13, 100])
def test_broken_off_file(spark, tmp_path, cut):
    data = b"".join(encoded(events(60)))[:-cut]
    (tmp_path / "t").write_bytes(data)
    got = read(trace.read_trace(spark, str(tmp_path / "t"), 2000))
    assert got == plain(data) and len(got) < 60


def test_folder_archive_and_empty_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = b"".join(encoded(events(30)))
    (tmp_path / "in" / "a").write_bytes(data)
    (tmp_path / "in" / "b").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "in" / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("other", b"no")
        z.writestr("log/tracefile", data)
    got = trace.read_trace(spark, str(tmp_path / "in"), 1000)
    assert sorted(r["idx"] for r in got.select("idx").collect()) == sorted([*range(1, 31)] * 2)
    assert read(trace.read_trace(spark, f"file://{tmp_path}/in/c.zip")) == plain(data)
    assert trace.read_trace(spark, str(tmp_path / "in" / "b")).count() == 0
    with pytest.raises(FileNotFoundError):
        trace.read_trace(spark, str(tmp_path / "none"))


def test_growing_file_through_the_stack_machine(spark, tmp_path):
    """Half a message at the end of each batch, and a new query on the same checkpoint for each: every event counts once."""
    evs = [T.enter("main", 100)]
    for i in range(30):
        evs += [T.enter("m", 101 + i), T.store(101 + i, "f", 100), T.var(101 + i, 1, 100), T.touch(101 + i, i % 2 == 0), T.leave("m")]
    data = b"".join(encoded(evs))
    path, got = tmp_path / "t", []
    spark.dataSource.register(trace.TraceDataSource)
    for part in (0.3, 0.31, 0.7, 1.0):
        path.write_bytes(data[: int(len(data) * part)])
        flat = loader.relevant(loader.flatten(spark.readStream.format("trace").option("split", 600).load(str(path))))
        query = stack_rows(flat).writeStream.option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(df.collect())).start()
        query.awaitTermination()
    uses = [r for r in got if r["place"] == "uses"]
    assert len(uses) == len({r["start"] for r in uses}) == 90
    assert {r["start"] for r in uses} == {i for i, (k, _) in enumerate(evs, 1) if k in ("fieldstore", "varstore", "readmodify")}
    calls = [r for r in got if r["place"] == "calls"]
    assert sorted((r["caller"], r["callee"]) for r in calls) == [(100, 101 + i) for i in range(30)]
