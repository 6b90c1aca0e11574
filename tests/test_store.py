import datetime
import random

import pytest

from tests.traces import enter, frame, leave, load, store, touch
from tracelens import cli, views
from tracelens.functions.text import listing, shown
from tracelens.operators import automata, loader, objects, stats
from tracelens.plans.compiler import Compiler
from tracelens.plans.parser import parse
from tracelens.sources import store as store_module
from tracelens.sources.store import Store, catalogue
from tracelens.streaming.counts import kind_counts, windowed_counts
from tracelens.streaming.stack import stack_rows

DATA = "/root/testdata/sf0.001"
GRID = ("MutableObj()", "CanReach(MutableObj())", "Deeply(ImmutableObj())")
#: Two immutable I (101, 102), two M written after publication (103, 104), one S read before its write (105).
TRACE = [e for tag, k in ((101, "I"), (102, "I"), (103, "M"), (104, "M"), (105, "S")) for e in (enter("<init>", tag, k), touch(tag, True, caller=tag), leave("<init>", k), store(50, f"f{tag}", tag))]
TRACE += [touch(101, False), touch(102, False), touch(103, True), touch(104, True), touch(105, False), touch(105, True), load(50, "f101", 101)]


def ids(df):
    return {r["id"] for r in df.collect()}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    return Store(spark, str(tmp_path_factory.mktemp("stores") / "run")).load(frame(spark, TRACE), "a comment")


def test_known_answers(loaded):
    assert ids(loaded.query("And(ImmutableObj() InstanceOf(I))")) == {101, 102}
    assert ids(loaded.query("MutableObj()")) == {50, 103, 104, 105} and ids(loaded.query("Not(StationaryObj())")) == {105} - ids(loaded.query("StationaryObj()"))
    assert ids(loaded.query("ReachableFrom(Set(50))")) == {50, 101, 102, 103, 104, 105} == ids(loaded.query("CanReach(Set(101))")) | {102, 103, 104, 105}


def test_automata_agree_with_queries(spark):
    flat = loader.relevant(loader.flatten(frame(spark, TRACE)))
    stationary = {r["id"] for r in automata.stationary(flat).filter("ok").collect()}
    tables = loader.load(frame(spark, TRACE))
    assert stationary == ids(Compiler(tables)("And(Obj() StationaryObj())"))
    stats_of = {r["klass"]: (r["succ"], r["fail"]) for r in automata.per_class_stats(flat, "immutable").collect()}
    assert stats_of == {"I": (2, 0), "M": (0, 2), "S": (0, 1)}


def test_moves(spark):
    events = [e for i in range(20) for e in (enter("<init>", 200 + i, "Foo"), leave("<init>", "Foo"), store(60, f"a{i}", 200 + i), store(61, f"b{i}", 200 + i), load(61 if i < 10 else 60, f"{'b' if i < 10 else 'a'}{i}", 200 + i))]
    per = automata.per_class_stats(loader.flatten(frame(spark, events)), "heap_moves").collect()
    assert [(r["succ"], r["fail"]) for r in per] == [(10, 10)]


def test_null_order_and_peers(spark):
    schema = "caller long, callee long, kind string, name string, refstart long, refend long, thread string"
    rows = [(1, 10, "field", "f", 1, None, "t"), (1, 11, "field", "f", 1, None, "t"), (2, 11, "field", "f", 5, 9, "t"), (1, 12, "field", "f", 1, 5, "t"), (2, 12, "field", "f", 5, None, "t")]
    assert ids(objects.unique({"refs": spark.createDataFrame(rows, schema)})) == {10, 12}


def test_cycles_end(spark):
    schema = "caller long, callee long, kind string, name string, refstart long, refend long, thread string"
    refs = spark.createDataFrame([(a, b, "field", "f", i, None, "t") for i, (a, b) in enumerate([(10, 11), (11, 12), (12, 10), (13, 10)], 1)], schema)
    tables = {"refs": refs, "objects": spark.createDataFrame([(i, "C") for i in (10, 11, 12, 13)], "id long, klass string")}
    assert ids(Compiler(tables)("ReachableFrom(Set(10))")) == {10, 11, 12} and ids(Compiler(tables)("CanReach(Set(12))")) == {10, 11, 12, 13}


def test_algebra_on_views(spark):
    c = Compiler(views.tables(spark, DATA))
    deep, heap, plain = ids(c("Deeply(ImmutableObj())")), ids(c("HeapDeeply(ImmutableObj())")), ids(c("ImmutableObj()"))
    assert deep <= heap <= plain and ids(c("CanHeapReach(MutableObj())")) <= ids(c("CanReach(MutableObj())"))


def test_cache_and_catalogue(spark, loaded):
    assert loaded.warm([parse(q) for q in GRID]) == 3 and loaded.warm([parse(q) for q in GRID]) == 0
    loaded.cache.clear(only_statistics=True)
    assert loaded.warm([parse(q) for q in GRID]) == 0
    loaded.cache.clear()
    loaded.spark.range(1).write.mode("overwrite").parquet(f"{loaded.folder}/../no_store/other")
    row = catalogue(spark, loaded.folder.rpartition("/")[0]).collect()[0]
    assert (row["name"], row["objects"], row["date"], row["comment"]) == ("run", 5, datetime.date.today().isoformat(), "a comment")
    assert loaded.sql("SELECT count(*) AS n FROM uses").first()["n"] > 0
    with pytest.raises(ValueError, match="SELECT nothing"):
        loaded.sql("SELECT nothing FROM nowhere")


def test_grid_statistics(spark, loaded):
    """Kept percentages equal those computed query by query, and are what clearing the statistics clears."""
    queries = [parse(q) for q in (*GRID, "ImmutableObj()", "TinyObj()", "Set(50 101 999)")]
    rows = loaded.grid(queries)
    t = loaded.tables()
    for q in queries:
        own = loaded.query(q)
        for statistic, want in (("class", stats.class_percentage(t, own).drop("klass")), ("field", stats.field_aggregate(t, own).drop("name")), ("object", stats.object_percentage(t, own))):
            got = loaded.percentages(q, statistic)
            assert sorted(map(tuple, got.drop("name").collect())) == sorted(map(tuple, want.collect())), (str(q), statistic)
    assert rows.select("query").distinct().count() == len(queries)
    assert loaded.cache.get("grid", "statistics") is not None
    loaded.cache.clear(only_statistics=True)
    assert loaded.cache.get("grid", "statistics") is None and loaded.warm(queries) == 0
    assert loaded.percentages("MutableObj()", "object").first()["passed"] == 4 and loaded.cache.get("grid", "statistics") is None


def test_many_sets_fit_the_bitmap(spark):
    sets = [spark.range(k, k + 3) for k in range(77)]
    found = {r["id"]: (r["m0"], r["m1"]) for r in stats.memberships(sets).collect()}
    for i in range(79):
        assert [k for k in range(77) if found[i][k // stats.WORD] >> k % stats.WORD & 1] == [k for k in range(77) if k <= i < k + 3]


def test_calls_by_time_reads_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "PER_CELL", 100)
    rng = random.Random(3)
    rows = [(1, i, "m", s := rng.randrange(1, 100_000), s + int(2 ** rng.uniform(0, 16)), "f", 1, "t") for i in range(3000)]
    store = Store(spark, str(tmp_path / "s")).write({"calls": spark.createDataFrame(rows, "caller long, callee long, name string, callstart long, callend long, callsitefile string, callsiteline long, thread string")})
    every = spark.read.parquet(f"{store.folder}/calls_by_time").select("_metadata.file_path").distinct().count()
    for t in (1, 777, 50_000, 99_999, 10**9):
        out = store.calls_at(t)
        assert {r["callee"] for r in out.collect()} == {i for _, i, _, s, e, *_ in rows if s <= t <= e}
        files = out._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in files and "PartitionFilters: []" not in files
    scan = store.calls_at(50_000)._jdf.queryExecution().sparkPlan().collectLeaves().head()
    assert 0 < scan.selectedPartitions().totalNumberOfFiles() < every / 5


def test_up_to_date_stores_are_left(spark, tmp_path, capsys):
    from tracelens.sources.trace import write_trace

    write_trace(TRACE, str(tmp_path / "t"))
    load = lambda *more: (cli.main(["load", "--store", str(tmp_path / "s"), *more, str(tmp_path / "t")], spark), capsys.readouterr().out)[1]
    assert load() == "" and load() == "up to date\n" and load("--force") == ""
    write_trace(TRACE[:-1], str(tmp_path / "t"))
    assert load() == "" and Store(spark, str(tmp_path / "s")).meta()["eventcount"] == str(len(TRACE) - 1)


def test_text_forms(spark, loaded):
    lines = [r["line"] for r in listing(frame(spark, TRACE)).orderBy("idx").collect()]
    assert lines[0] == "#1: ==>  (I @ 101) . <init>()V , callsite=C.java:1 , thread=main" and lines[1] == "#2: readmodify - callee=C @ 101 , caller=C @ 101 writes x"
    assert shown(loaded.table("objects"), 2).endswith("...\nTOTAL: 5 rows selected")
    assert stats.apropos_json(loaded.tables(), 101).count() == 4  # two uses, a call, a reference


def test_streams(spark, tmp_path):
    from tracelens.model import EVENTS

    frame(spark, TRACE).write.parquet(str(tmp_path / "in"))
    flat = loader.relevant(loader.flatten(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))))
    for name, df, mode in (("kinds", kind_counts(flat), "complete"), ("rows", stack_rows(flat), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    batch = {r["kind"]: r["n"] for r in automata.count_kinds(loader.flatten(frame(spark, TRACE))).filter("kind != 'total'").collect()}
    assert {r["kind"]: r["n"] for r in spark.table("kinds").collect()} == batch
    calls = sorted((r["callee"], r["start"], r["end"]) for r in spark.table("rows").filter("place = 'calls'").collect())
    assert calls == sorted((r["callee"], r["callstart"], r["callend"]) for r in loader.load(frame(spark, TRACE))["calls"].collect())


def test_windowed_counts(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    assert windowed_counts(events).agg({"n": "sum"}).first()[0] == events.count()


def test_command_line(spark, tmp_path, capsys):
    from tracelens.sources.trace import write_trace

    write_trace(TRACE, str(tmp_path / "trace.bin"))
    assert cli.main(["load", "--store", str(tmp_path / "s"), str(tmp_path / "trace.bin")], spark) == 0
    cli.main(["cat", str(tmp_path / "trace.bin")], spark)
    cli.main(["query", "--store", str(tmp_path / "s"), "InstanceOf(M)"], spark)
    cli.main(["cache", "--store", str(tmp_path / "s"), "--clear"], spark)
    out = capsys.readouterr().out
    assert "#1: ==> " in out and "TOTAL: 2 rows selected" in out
