import pytest

from tests.traces import enter, frame, late, leave, load, store, touch, var, varload
from tracelens.operators import automata, loader
from tracelens.sources import capnp
from tracelens.streaming.stack import StackMachine


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_calls_and_callers(spark):
    t = loader.load(frame(spark, [enter("main", 100), enter("<init>", 101), leave("<init>"), enter("f", 102), leave("f"), leave("main")]))
    assert rows(t["calls"], "caller", "callee", "name", "callstart", "callend") == [(4, 100, "main", 1, 6), (100, 101, "<init>", 2, 3), (100, 102, "f", 4, 5)]


def test_exit_mismatch_pops_and_writes_no_call(spark):
    t = loader.load(frame(spark, [enter("a", 100), enter("b", 101), var(101, 1, 200), leave("x"), enter("c", 102), leave("c"), leave("a"), leave("a")]))
    assert rows(t["calls"], "caller", "callee", "callstart", "callend") == [(4, 100, 1, 7), (100, 102, 5, 6)]
    assert rows(t["refs"], "caller", "callee", "refstart", "refend") == [(101, 200, 3, None)]
    assert rows(t["quarantine"], "idx") == [(8,)]


def test_constructor_chain_collapses(spark):
    events = [enter("<init>", 12, line=i) if j == 0 else leave("<init>") for i in (1, 2, 3) for j in (0, 1)]
    t = loader.load(frame(spark, events))
    assert rows(t["calls"], "callee", "callstart", "callend", "callsiteline") == [(12, 1, 6, 3)]
    assert rows(t["objects"], "id", "klass", "allocationsiteline") == [(12, "C", 1)]


def test_upsert_takes_last_class_first_site(spark):
    events = [enter("<init>", 9, "a/Base", "t1", "A.java", 3), leave("<init>", thread="t1"), enter("<init>", 9, "a/Derived", "t2", "B.java", 5), leave("<init>", thread="t2")]
    assert rows(loader.load(frame(spark, events))["objects"], "id", "klass", "allocationsitefile", "allocationsiteline", "thread") == [(9, "a.Derived", "A.java", 3, "t1")]


def test_variable_slots(spark):
    t = loader.load(frame(spark, [enter("f", 100), var(100, 1, 7), var(100, 1, 8), var(100, 2, 9), var(100, 2, 0), var(100, 3, 10), leave("f")]))
    assert rows(t["refs"], "callee", "name", "refstart", "refend") == [(7, "var_1", 2, 3), (8, "var_1", 3, 7), (9, "var_2", 4, 5), (10, "var_3", 6, 7)]


def test_field_ends_and_null_stores(spark):
    events = [store(50, "f", 5), store(50, "f", 6), store(50, "f", 0), store(50, "g", 7)]
    assert rows(loader.load(frame(spark, events))["refs"], "callee", "refstart", "refend") == [(5, 1, 2), (6, 2, None), (7, 4, None)]
    assert rows(loader.load(frame(spark, events), null_store_closes=True)["refs"], "callee", "refstart", "refend") == [(5, 1, 2), (6, 2, 3), (7, 4, None)]


def test_runtime_threads_vanish_but_idx_counts(spark):
    t = loader.load(frame(spark, [store(50, "f", 5, thread="Finalizer"), store(50, "f", 6, thread="<x>"), load(50, "f", 6)]))
    assert rows(t["uses"], "kind", "idx") == [("fieldload", 3)] and t["refs"].count() == 0


def test_late_init_is_an_option(spark):
    events = [late(77, f=5, g=0)]
    assert loader.load(frame(spark, events))["objects"].count() == 0
    t = loader.load(frame(spark, events), include_late_init=True)
    assert rows(t["refs"], "caller", "callee", "refstart", "refend") == [(77, 5, 1, None)] and rows(t["objects"], "id", "klass") == [(77, "a.b.C")]


def test_broken_rows_are_reported(spark):
    t = loader.load(frame(spark, [store(0, "f", 5), load(50, "", 6)]))
    assert sorted(r["why"] for r in loader.broken_rows(t).collect()) == ["empty name", "zero id", "zero id"]
    bad = {
        "uses": "select cast(null as long) caller, 5L callee, 'f' name, '' method, cast(null as string) kind, 0L idx, cast(null as string) thread",
        "refs": "select 5L caller, 6L callee, 'heap' kind, 'f' name, cast(null as long) refstart, cast(null as long) refend, 't' thread",
        "calls": "select 5L caller, cast(null as long) callee, 'm' name, 7L callstart, 6L callend, 'C.java' callsitefile, 1L callsiteline, 't' thread",
        "objects": "select cast(null as long) id, 'C' klass, cast(null as string) allocationsitefile, 1 allocationsiteline, 1L firstusage, 1L lastusage, 't' thread",
    }
    found = loader.broken_rows({k: spark.sql(v) for k, v in bad.items()})
    assert {r["place"]: r["why"] for r in found.collect()} == {
        "uses": "zero id, unknown kind, no place, no method, no thread", "refs": "unknown kind, no start", "calls": "zero id, ends too early", "objects": "zero id, no site"}


def _mixed(n=400, seed=7):
    import random

    r, depth, out = random.Random(seed), {"a": [], "b": []}, []
    for i in range(n):
        t = r.choice("ab")
        kind = r.randrange(6)
        if kind == 0 or kind == 1 and not depth[t] and r.random() < 0.7:
            name = r.choice("fgh")
            depth[t].append(name)
            out.append(enter(name, 100 + i, thread=t, line=i))
        elif kind == 1:
            name = depth[t].pop() if depth[t] else "f"
            out.append(leave(name if r.random() < 0.8 else "other", thread=t))
        elif kind == 2:
            out.append(var(300 + r.randrange(3), r.randrange(3), r.choice([0, 5, 6]), thread=t))
        elif kind == 3:
            out.append(touch(500, r.random() < 0.5, thread=t))
        elif kind == 4:
            out.append(varload(300, 1, 5, thread=t))
        else:
            out.append(store(600, "f", 5, thread=t))
    return out


@pytest.mark.parametrize("chunk", [1_000_000, 37, 1])
def test_windows_equal_the_stack_machine(spark, chunk):
    events = frame(spark, _mixed())
    t = loader.load(events, chunk=chunk)
    flat = loader.relevant(loader.flatten(events)).orderBy("idx").collect()
    machines, want = {}, []
    for e in flat:
        m = machines.setdefault(e["thread"], StackMachine())
        want += [(*r, e["thread"]) for r in m.step(e.asDict())]
    for name, m in machines.items():
        want += [(*r, name) for f in m.frames for r in m.open_edges(f)]
    key = lambda r: tuple((x is None, x) for x in r)
    got = rows(t["uses"], "caller", "callee", "name", "method", "kind", "idx", "thread")
    assert got == sorted([(r[1], r[2], r[3], r[4], r[5], r[6], r[10]) for r in want if r[0] == "uses"], key=key)
    got = rows(t["refs"].filter("kind = 'var'"), "caller", "callee", "name", "refstart", "refend", "thread")
    assert got == sorted([(r[1], r[2], r[3], r[6], r[7], r[10]) for r in want if r[0] == "refs"], key=key)
    got = rows(t["calls"], "caller", "callee", "name", "callstart", "callend", "thread")
    assert got == sorted([(r[1], r[2], r[3], r[6], r[7], r[10]) for r in want if r[0] == "calls"], key=key)
    assert rows(t["quarantine"], "idx") == sorted((r[6],) for r in want if r[0] == "quarantine")


def test_check_stack(spark):
    flat = loader.relevant(loader.flatten(frame(spark, [enter("a", 100), leave("b")])))
    frames, _ = loader.in_frames(loader.with_depth(flat))
    assert rows(automata.check_stack(frames), "idx", "name", "exit_name") == [(2, "a", "b")]


def test_allocators_come_from_the_frame_below(spark):
    events = [enter("<init>", 40), leave("<init>"), enter("main", 50), enter("<init>", 101), store(101, "f", 7), leave("<init>"), enter("<init>", 102, thread="t2"), leave("<init>", thread="t2"), enter("<init>", 103), leave("<init>"), leave("main")]
    out = automata.log_field_refs(loader.flatten(frame(spark, events)))
    assert rows(out, "id", "field", "vals") == [(50, "<ALLOCATED_OBJS>", [101, 103]), (101, "f", [7])]


def test_binary_round_trip(tmp_path):
    events = [enter("main", 100, "Ä.B"), late(77, f=5, g=-3), store(50, "f", -5), load(50, "f", 6), var(3, 127, 9), varload(3, -2, 9), touch(8, True), leave("main"), touch(8, False), late(5)]
    path = tmp_path / "tracefile"
    path.write_bytes(b"".join(capnp.encode(*e) for e in events) + b"\0\0")
    with open(path, "rb") as f:
        assert [(k, v) for _, k, v in capnp.events(f)] == events


def test_trace_sources_agree(spark, tmp_path):
    import zipfile

    from tracelens.sources.trace import TraceDataSource, read_trace, write_trace

    events = [enter("main", 100), late(77, f=5), store(50, "f", 5), touch(8, True), leave("main")]
    write_trace(events, str(tmp_path / "t.bin"))
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.write(tmp_path / "t.bin", "x/tracefile")
    want = sorted(map(str, frame(spark, events).collect()))
    assert sorted(map(str, read_trace(spark, str(tmp_path / "t.bin")).collect())) == want
    assert sorted(map(str, read_trace(spark, str(tmp_path / "t.zip")).collect())) == want
    spark.dataSource.register(TraceDataSource)
    assert sorted(map(str, spark.read.format("trace").load(str(tmp_path / "t.bin")).collect())) == want
