"""Per-object and per-thread automata over flat events (see ``loader.flatten``), as windows and aggregates.

An automaton that only needs the first, last or running value of something is an aggregate; ``observe`` is the general
fold for those that aren't. A protocol gives (id, ok) for the objects it is asked about.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.functions.text import bar, listing
from tracelens.model import arrow_schema
from tracelens.operators import loader
from tracelens.operators.scans import CHUNK, peaks, running

BACKGROUND = ("DestroyJavaVM",)


# ---- plumbing


def succeed(flat: DataFrame) -> DataFrame:
    return flat.withColumn("accepting", F.lit(True))


def ignore_background(flat: DataFrame) -> DataFrame:
    return flat.filter(~(F.col("thread").contains("JVM_Thread<") | F.col("thread").isin(*BACKGROUND)))


def traced(events: DataFrame) -> DataFrame:
    """idx, line: the events of a trace as text, without the runtime's background threads."""
    return listing(events.filter(~(loader.thread_of().contains("JVM_Thread<") | loader.thread_of().isin(*BACKGROUND))))


def guarded(flat: DataFrame, predicate: Column, inner: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return inner(flat.filter(predicate))


def labelled(df: DataFrame, label: str) -> DataFrame:
    return df.select(F.lit(label).alias("label"), "*")


def two(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both results under labels 1 and 2; a shared scan is read once by exchange reuse."""
    return labelled(first, "1").unionByName(labelled(second, "2"), allowMissingColumns=True)


def counted(flat: DataFrame) -> DataFrame:
    return flat.agg(F.count("*").alias("events"), F.max("idx").alias("last_idx"))


def partitioned(flat: DataFrame, key: Column, inner: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Routes events to one inner automaton per key: ``inner`` gets the events and the name of the key column."""
    return inner(flat.withColumn("key", key), "key")


def forever(flat: DataFrame, predicate: Column, by: str = "callee", chunk: int = CHUNK) -> DataFrame:
    """idx, key, accepting: once the predicate failed for a key, it stays failed."""
    holds = F.coalesce(predicate, F.lit(False)).cast("int")
    return running(flat, [by], "_holds", holds, "min", chunk=chunk).select("idx", F.col(by).alias("key"), (F.col("_holds") == 1).alias("accepting"))


def observe(flat: DataFrame, by: str, columns: list[str], state: str, summarise: Callable, combine: Callable, accept: Callable, chunk: int = CHUNK) -> DataFrame:
    """The general fold, in two levels: key, accepting.

    ``summarise(arrays)`` gets the ``columns`` of a key's events within one chunk, as numpy arrays in order of idx, and gives a tuple of the
    fields of ``state`` (DDL); ``combine(a, b)`` joins the states of two neighbouring stretches of events, ``accept(state)`` decides. A
    chunk of a key is one call over whole columns, and a hot key is as many groups as it has chunks; the second
    level sees one row for each of them.
    """
    kind = dict(flat.dtypes)[by]
    names = [x.split()[0] for x in state.split(", ")]
    of_chunk, decided = arrow_schema(f"key {kind}, chunk long, {state}"), arrow_schema(f"key {kind}, accepting boolean")

    def first(batches):
        import pyarrow as pa

        held = []
        for key, chunk_no, arrays, ends in _stretches(batches, columns):
            held.append(arrays)
            if ends:
                import numpy as np

                out = summarise({c: np.concatenate([h[c] for h in held]) for c in columns})
                held = []
                yield pa.RecordBatch.from_pylist([{"key": key, "chunk": chunk_no, **dict(zip(names, out))}], of_chunk)

    def second(batches):
        import pyarrow as pa

        now, done = None, []
        for batch in batches:
            for row in batch.to_pylist():
                part = tuple(row[n] for n in names)
                if now is None or now[0] != row["key"]:
                    if now is not None:
                        done.append({"key": now[0], "accepting": bool(accept(now[1]))})
                    now = (row["key"], part)
                else:
                    now = (now[0], combine(now[1], part))
            if done:
                yield pa.RecordBatch.from_pylist(done, decided)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"key": now[0], "accepting": bool(accept(now[1]))}], decided)

    rows = flat.select(F.col(by).alias("key"), F.floor(F.col("idx") / chunk).alias("chunk"), "idx", *[c for c in columns if c != "idx"])
    parts = rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "idx").mapInArrow(first, f"key {kind}, chunk long, {state}")
    return parts.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(second, f"key {kind}, accepting boolean")


def _stretches(batches, columns: list[str]):
    """(key, chunk, columns as numpy arrays, whether the group ends here) of sorted Arrow batches; a group may span batches."""
    import numpy as np

    held = None
    for batch in batches:
        key, chunk = batch.column("key").to_pylist(), batch.column("chunk").to_numpy(zero_copy_only=False)
        if not key:
            continue
        cuts = [i for i in (np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist()]
        cuts = sorted({0, len(key), *cuts, *[i for i in range(1, len(key)) if key[i] != key[i - 1]]})
        for lo, hi in zip(cuts, cuts[1:]):
            if held is not None:
                yield (*held, (held[0], held[1]) != (key[lo], chunk[lo]))
            held = (key[lo], int(chunk[lo]), {c: batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in columns})
    if held is not None:
        yield (*held, True)


# ---- logs and counts


def kind_name() -> Column:
    return F.when(F.col("kind") == "readmodify", F.when(F.col("is_modify"), "modify").otherwise("read")).otherwise(F.col("kind"))


def count_kinds(flat: DataFrame) -> DataFrame:
    """kind, n; the row with kind ``total`` counts all."""
    per = flat.groupBy(kind_name().alias("kind")).agg(F.count("*").alias("n"))
    return per.unionByName(flat.agg(F.lit("total").alias("kind"), F.count("*").alias("n")))


def kind_bars(flat: DataFrame) -> DataFrame:
    """kind, n and a bar of the number against the next power of ten."""
    return count_kinds(flat).withColumn("bar", bar(F.col("n")))


def log_var_refs(flat: DataFrame) -> DataFrame:
    """id, var (method::slot), vals: what each variable held."""
    v = flat.filter("kind = 'varstore'")
    name = F.concat(F.coalesce("callermethod", F.lit("")), F.lit("::"), F.col("var").cast("string"))
    return v.groupBy(F.col("caller").alias("id"), name.alias("var")).agg(F.sort_array(F.collect_set("val")).alias("vals"))


def log_field_refs(flat: DataFrame) -> DataFrame:
    """id, field, vals: what each field held; objects that were constructed while an object's method was on top of the thread's stack
    come as its ``<ALLOCATED_OBJS>``. Constructors on an empty stack belong to no object."""
    f = flat.filter("kind = 'fieldstore'").select(F.col("callee").alias("id"), F.col("name").alias("field"), "val")
    frames, _ = loader.in_frames(loader.with_depth(flat.filter("kind in ('methodenter', 'methodexit')")))
    made = frames.filter("name = '<init>' and frame is not null").select(F.col("frame.callee").alias("id"), F.lit("<ALLOCATED_OBJS>").alias("field"), F.col("callee").alias("val"))
    return f.unionByName(made).groupBy("id", "field").agg(F.sort_array(F.collect_set("val")).alias("vals"))


def log_types(flat: DataFrame) -> DataFrame:
    """id, klass: the first class an object's methods ran under."""
    return flat.filter("kind = 'methodenter'").groupBy(F.col("callee").alias("id")).agg(F.min_by("klass", "idx").alias("klass"))


def check_stack(frames: DataFrame) -> DataFrame:
    """Exits whose name isn't that of the frame they end (``frames``: of ``loader.in_frames``)."""
    return frames.filter(F.col("exit").isNotNull() & (F.col("exit_name") != F.col("name"))).select(F.col("exit").alias("idx"), "thread", "name", "exit_name")


def reference_graph(flat: DataFrame) -> DataFrame:
    """src, dst, label, n: references by label that are open in the end; a store adds the new and takes away the old."""
    s = flat.filter("kind = 'fieldstore'")
    moves = s.select(F.col("callee").alias("src"), F.col("name").alias("label"), F.explode(F.array(
        F.struct(F.col("val").alias("dst"), F.lit(1).alias("d")), F.struct(F.col("oldval").alias("dst"), F.lit(-1).alias("d")))).alias("m"))
    return moves.filter("m.dst != 0").groupBy("src", F.col("m.dst").alias("dst"), "label").agg(F.sum("m.d").alias("n")).filter("n != 0")


def dot(edges: list[tuple]) -> str:
    """GraphViz text of (src, dst, label, n) rows."""
    return "digraph {\n" + "".join(f'  "{a}" -> "{b}" [label="{label} x{n}"];\n' for a, b, label, n in edges) + "}\n"


def max_in_degree(flat: DataFrame, n: int, chunk: int = CHUNK) -> DataFrame:
    """id, ok: never more than n fields held the object at once."""
    s = flat.filter("kind = 'fieldstore'")
    moves = s.select("idx", F.explode(F.array(F.struct(F.col("val").alias("id"), F.lit(1).alias("d")), F.struct(F.col("oldval").alias("id"), F.lit(-1).alias("d")))).alias("m")).filter("m.id > 4")
    return peaks(moves.select(F.col("m.id").alias("id"), "idx", F.col("m.d").alias("d")), "id", "idx", "d", chunk).select("id", (F.col("peak") <= n).alias("ok"))


# ---- protocols


def allocated(flat: DataFrame) -> DataFrame:
    return flat.filter("kind = 'methodenter' and name = '<init>' and callee > 4").groupBy(F.col("callee").alias("id")).agg(F.min("idx").alias("born"))


_MODIFY = "(kind = 'fieldstore' or (kind = 'readmodify' and is_modify))"
_READ = "(kind = 'fieldload' or (kind = 'readmodify' and not is_modify))"
_MOVED = "kind in ('fieldstore', 'fieldload', 'varstore', 'varload') and val > 4"


def any_object(flat: DataFrame) -> DataFrame:
    return allocated(flat).select("id", F.lit(True).alias("ok"))


def _asked(flat: DataFrame, failed: DataFrame) -> DataFrame:
    return allocated(flat).join(failed.select("id").distinct().withColumn("_bad", F.lit(True)), "id", "left").select("id", F.col("_bad").isNull().alias("ok"))


def immutable(flat: DataFrame) -> DataFrame:
    """Not written to after some field, variable or load has given the object out."""
    published = flat.filter(_MOVED).groupBy(F.col("val").alias("id")).agg(F.min("idx").alias("out"))
    written = flat.filter(_MODIFY).groupBy(F.col("callee").alias("id")).agg(F.max("idx").alias("last"))
    return _asked(flat, published.join(written, "id").filter("last > out"))


def thread_local(flat: DataFrame) -> DataFrame:
    """Touched, given out or constructed by one thread only."""
    seen = flat.filter("callee > 4").select(F.col("callee").alias("id"), "thread").union(flat.filter(_MOVED).select(F.col("val").alias("id"), "thread"))
    per = seen.groupBy("id").agg(F.min("thread").alias("a"), F.max("thread").alias("b"))
    return _asked(flat, per.filter("a < b"))


def stationary(flat: DataFrame) -> DataFrame:
    """Not written to after a field was read."""
    per = flat.filter(f"{_MODIFY} or {_READ}").groupBy(F.col("callee").alias("id"))
    per = per.agg(F.min(F.when(F.expr(_READ), F.col("idx"))).alias("r"), F.max(F.when(F.expr(_MODIFY), F.col("idx"))).alias("w"))
    return _asked(flat, per.filter("r < w"))


def loads_from_elsewhere(flat: DataFrame, variables: bool, any_variable: bool = False, chunk: int = CHUNK) -> DataFrame:
    """id, idx of loads that come from another place than the newest store of the object."""
    kinds = ("fieldstore", "fieldload") + (("varstore", "varload") if variables else ())
    field = F.concat(F.lit("f:"), F.col("callee").cast("string"), F.lit(":"), F.coalesce("name", F.lit("")))
    slot = F.lit("v") if any_variable else F.concat(F.lit("v:"), F.col("caller").cast("string"), F.lit(":"), F.col("var").cast("string"))
    moves = flat.filter(F.col("kind").isin(*kinds) & (F.col("val") > 4)).select(
        F.col("val").alias("id"), "idx", F.col("kind").endswith("store").alias("store"), F.when(F.col("kind").startswith("field"), field).otherwise(slot).alias("place"))
    moves = running(moves, ["id"], "newest", F.when(F.col("store"), F.col("place")), inclusive=False, chunk=chunk)
    return moves.filter(~F.col("store") & (F.col("newest") != F.col("place"))).select("id", "idx")


def unique(flat: DataFrame) -> DataFrame:
    return _asked(flat, loads_from_elsewhere(flat, True))


def heap_moves(flat: DataFrame) -> DataFrame:
    return _asked(flat, loads_from_elsewhere(flat, False))


def moves(flat: DataFrame) -> DataFrame:
    return _asked(flat, loads_from_elsewhere(flat, True, any_variable=True))


def lifecycle_violations(flat: DataFrame) -> DataFrame:
    """id, idx, why: events on a constructed object before its construction, and loads from a place that isn't its newest."""
    touched = flat.filter("callee > 4").select(F.col("callee").alias("id"), "idx")
    early = touched.join(allocated(flat), "id").filter("idx < born").select("id", "idx", F.lit("before construction").alias("why"))
    return early.unionByName(loads_from_elsewhere(flat, True).withColumn("why", F.lit("not the owner")))


PROTOCOLS = {"any": any_object, "immutable": immutable, "thread_local": thread_local, "stationary": stationary, "unique": unique, "heap_moves": heap_moves, "moves": moves}


def debugged(flat: DataFrame, id: int) -> DataFrame:
    """The events that concern one object."""
    return flat.filter((F.col("callee") == id) | (F.col("caller") == id) | (F.col("val") == id))


def per_class_stats(flat: DataFrame, protocol: str) -> DataFrame:
    """klass, prop, succ, fail: how many objects of a class keep to the protocol."""
    per = PROTOCOLS[protocol](flat).join(log_types(flat), "id").groupBy("klass").agg(F.count_if("ok").alias("succ"), F.count_if(~F.col("ok")).alias("fail"))
    return per.select("klass", (F.col("succ").cast("double") / (F.col("succ") + F.col("fail"))).alias("prop"), "succ", "fail")


def per_object_stats(flat: DataFrame, protocol: str) -> DataFrame:
    """id, status: one row per object; a set of ids per status would be one value of the whole trace's size."""
    return PROTOCOLS[protocol](flat).select("id", F.when(F.col("ok"), "survived").otherwise("failed").alias("status"))


def per_object_query(flat: DataFrame, protocol: str) -> DataFrame:
    """One row: alive, dead, callees (distinct ones in the trace), ignored (those never constructed)."""
    verdicts = PROTOCOLS[protocol](flat).agg(F.count_if("ok").alias("alive"), F.count_if(~F.col("ok")).alias("dead"))
    seen = flat.filter("callee is not null").select("callee").distinct().agg(F.count("*").alias("callees"))
    return verdicts.crossJoin(seen).select("alive", "dead", "callees", (F.col("callees") - F.col("alive") - F.col("dead")).alias("ignored"))  # one row each


def one_per_object(verdicts: DataFrame) -> DataFrame:
    """One row: objects, accepting, perc of an (id, ok) result."""
    from tracelens.operators.stats import percentage

    return verdicts.agg(F.count("*").alias("objects"), F.count_if("ok").alias("accepting")).withColumn("perc", percentage(F.col("accepting"), F.col("objects")))


def lifetimes(flat: DataFrame) -> DataFrame:
    """id, first, last: the span in which an object was touched."""
    return flat.filter("callee > 4").groupBy(F.col("callee").alias("id")).agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
