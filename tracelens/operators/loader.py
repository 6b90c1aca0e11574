"""Events to tables.

The loader's call stacks are expressed as windows. A running depth per thread (computed in two levels, chunks of the
trace first) gives every event the frame level it happens in; the frame itself is the last one entered at that level, which is looked up
in two levels as well, so neither one busy thread nor a trace of one thread and level is one task. An exit closes the frame of its level whatever its name says; if the names differ, no call is
written. Exits on an empty stack go to quarantine and don't lower the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelens.model import JVM, REF_KINDS, TABLES, USE_KINDS
from tracelens.operators.scans import CHUNK, running
from tracelens.plans.cutting import cut, delete, work_path

IGNORED_THREADS = ("DestroyJavaVM", "Finalizer")
UNKNOWN_THREAD, UNKNOWN_METHOD = "<unknown thread>", "<unknown>"


def thread_of(kind: Column | None = None) -> Column:
    names = [F.col(k)["threadName"] for k in ("methodenter", "methodexit", "fieldstore", "fieldload", "varstore", "varload", "readmodify")]
    return F.coalesce(*names, F.lit(UNKNOWN_THREAD))


def flatten(events: DataFrame) -> DataFrame:
    """One flat row per event, with the columns that any transform looks at."""
    f = lambda k, c: F.col(k)[c]
    is_modify = f("readmodify", "isModify")
    return events.select(
        "idx", "kind", thread_of().alias("thread"),
        F.coalesce(f("methodenter", "name"), f("methodexit", "name"), f("fieldstore", "fname"), f("fieldload", "fname"), f("readmodify", "fname")).alias("name"),
        F.coalesce(f("methodenter", "calleeclass"), f("methodexit", "cname"), f("fieldstore", "holderclass"), f("fieldload", "holderclass"), f("readmodify", "calleeclass"), f("lateinit", "calleeclass")).alias("klass"),
        F.coalesce(f("methodenter", "calleetag"), f("fieldstore", "holdertag"), f("fieldload", "holdertag"), f("readmodify", "calleetag"), f("lateinit", "calleetag")).alias("callee"),
        F.coalesce(f("fieldstore", "callertag"), f("fieldload", "callertag"), f("varstore", "callertag"), f("varload", "callertag"), f("readmodify", "callertag")).alias("caller"),
        F.coalesce(f("fieldstore", "callermethod"), f("fieldload", "callermethod"), f("varstore", "callermethod"), f("varload", "callermethod")).alias("callermethod"),
        F.coalesce(f("fieldstore", "newval"), f("varstore", "newval"), f("fieldload", "val"), f("varload", "val")).alias("val"),
        F.coalesce(f("fieldstore", "oldval"), f("varstore", "oldval")).alias("oldval"),
        F.coalesce(f("varstore", "var"), f("varload", "var")).cast("int").alias("var"), is_modify.alias("is_modify"),
        f("methodenter", "callsitefile").alias("sitefile"), f("methodenter", "callsiteline").alias("siteline"), f("lateinit", "fields").alias("fields"),
    )


def relevant(flat: DataFrame, include_late_init: bool = False) -> DataFrame:
    """Without the runtime's own threads. Their events keep their places: idx is not renumbered."""
    noise = F.col("thread").isin(*IGNORED_THREADS) | F.col("thread").startswith("<")
    late = (F.col("kind") == "lateinit") if include_late_init else F.lit(False)
    return flat.filter(~noise | late)


def with_depth(flat: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds ``depth``, frames on the thread's stack after the event, and ``underflow`` (an exit on an empty stack)."""
    step = F.when(F.col("kind") == "methodenter", 1).when(F.col("kind") == "methodexit", -1).otherwise(0)
    e = flat.withColumn("_step", step.cast("long")).withColumn("_chunk", F.floor(F.col("idx") / chunk))
    local = W.partitionBy("thread", "_chunk").orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    e = e.withColumn("_sum", F.sum("_step").over(local)).withColumn("_low", F.min("_sum").over(local))
    # what a chunk adds and how low it goes; a few rows for each thread and million events
    parts = e.groupBy("thread", "_chunk").agg(F.sum("_step").alias("total"), F.min("_low").alias("low"))
    before = W.partitionBy("thread").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    parts = parts.withColumn("_floor", F.least(F.lit(0), F.coalesce(F.min(F.col("_base") + F.col("low")).over(before), F.lit(0))))
    e = e.join(parts.select("thread", "_chunk", "_base", "_floor"), ["thread", "_chunk"])
    run = F.col("_base") + F.col("_sum")
    low = F.least(F.col("_floor"), F.col("_base") + F.col("_low"), F.lit(0))
    prior_low = F.least(F.col("_floor"), F.coalesce(F.col("_base") + F.lag("_low").over(W.partitionBy("thread", "_chunk").orderBy("idx")), F.col("_floor")), F.lit(0))
    return e.withColumn("underflow", (F.col("kind") == "methodexit") & (run < prior_low)).withColumn("depth", run - low).drop("_step", "_chunk", "_sum", "_low", "_base", "_floor")


def in_frames(deep: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(frames, others): the method frames with their exit and the frame below, and the stores and reads that need
    to know the frame they happen in (frame, frame_name; null on an empty stack)."""
    enter, leave = F.col("kind") == "methodenter", (F.col("kind") == "methodexit") & ~F.col("underflow")
    spark = deep.sparkSession
    places = [work_path(spark, name) for name in ("deep", "entered", "framed")]
    # each step looks at its rows twice, so it gets them from a table and not from all that led to them
    deep = cut(deep, places[0])
    own = deep.filter(enter | leave).withColumn("level", F.when(leave, F.col("depth") + 1).otherwise(F.col("depth")))
    own = running(own, ["thread", "level"], "_next", F.struct("kind", "idx", "name"), inclusive=False, back=True, chunk=chunk)
    closed = F.col("_next.kind") == "methodexit"
    entered = cut(own.filter(enter).withColumn("exit", F.when(closed, F.col("_next.idx"))).withColumn("exit_name", F.when(closed, F.col("_next.name"))).drop("_next"), places[1])
    # a frame is a fact at its own level and asks one level down for its caller; other events ask at their own level
    roles = F.array(*[F.struct((F.col("level") - down).alias("level"), F.lit(bool(down)).alias("asks")) for down in (0, 1)])
    both = entered.withColumn("_role", F.explode(roles)).withColumn("level", F.col("_role.level")).withColumn("asks", F.col("_role.asks")).drop("_role")
    frame_of = deep.filter(F.col("kind").isin("readmodify", "varstore")).withColumn("level", F.col("depth")).withColumn("asks", F.lit(True))
    rows = both.unionByName(frame_of, allowMissingColumns=True)
    fact = F.when(~F.col("asks"), F.struct(F.col("idx").alias("idx"), F.col("callee").alias("callee"), F.col("name").alias("name"), F.col("exit").alias("exit"), (F.col("exit_name") == F.col("name")).alias("clean")))
    found = running(rows, ["thread", "level"], "frame", fact, chunk=chunk).filter("asks")
    found = cut(found.withColumn("frame", F.when(F.col("level") > 0, F.col("frame"))), places[2])
    delete(spark, *places[:2])
    return found.filter(enter), found.filter(~enter)


def uses(flat: DataFrame, framed: DataFrame) -> DataFrame:
    name = F.when(F.col("kind").isin("varload", "varstore"), F.concat(F.lit("var_"), F.col("var").cast("string"))).otherwise(F.col("name"))
    own = F.col("kind").isin("varload", "varstore")
    plain = flat.filter(F.col("kind").isin("fieldload", "fieldstore", "varload", "varstore")).select(
        "caller", F.when(own, F.col("caller")).otherwise(F.col("callee")).alias("callee"), name.alias("name"), F.col("callermethod").alias("method"), "kind", "idx", "thread")
    touched = framed.filter(F.col("kind") == "readmodify").select(
        "caller", "callee", "name", F.coalesce("frame.name", F.lit(UNKNOWN_METHOD)).alias("method"), F.when(F.col("is_modify"), "modify").otherwise("read").alias("kind"), "idx", "thread")
    return plain.unionByName(touched)


def field_refs(flat: DataFrame, null_store_closes: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Field edges: opened by a store of an object, closed by the next one to the same field. Storing null closes nothing
    unless asked to."""
    stores = flat.filter(F.col("kind") == "fieldstore")
    stores = stores if null_store_closes else stores.filter("val != 0")
    return running(stores, ["callee", "name"], "refend", F.col("idx"), inclusive=False, back=True, chunk=chunk).filter("val != 0").select(
        F.col("callee").alias("caller"), F.col("val").alias("callee"), F.lit("field").alias("kind"), "name", F.col("idx").alias("refstart"), "refend", "thread")


def var_refs(framed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Variable edges: closed by the next store to the slot in the same frame, or by the frame's exit if it ran cleanly."""
    stores = framed.filter(F.col("kind") == "varstore")
    slot = ["thread", F.col("frame.idx").alias("frame"), "var"]
    stores = running(stores, slot, "_later", F.col("idx"), inclusive=False, back=True, chunk=chunk)
    end = F.when(F.col("frame").isNotNull(), F.coalesce("_later", F.when(F.col("frame.clean"), F.col("frame.exit"))))
    return stores.withColumn("refend", end).filter("val != 0").select(
        "caller", F.col("val").alias("callee"), F.lit("var").alias("kind"), F.concat(F.lit("var_"), F.col("var").cast("string")).alias("name"), F.col("idx").alias("refstart"), "refend", "thread")


def raw_calls(frames: DataFrame) -> DataFrame:
    clean = frames.filter(F.col("exit").isNotNull() & (F.col("exit_name") == F.col("name")))
    return clean.select(F.coalesce("frame.callee", F.lit(JVM)).cast("long").alias("caller"), "callee", "name", F.col("idx").alias("callstart"), F.col("exit").alias("callend"),
        F.col("sitefile").alias("callsitefile"), F.col("siteline").alias("callsiteline"), "thread")


def collapse_constructors(calls: DataFrame) -> DataFrame:
    """One ``<init>`` call per callee, from the first start to the last end, with the attributes of the one that ends
    last; constructors of a class chain are traced one after another."""
    inits = calls.filter(F.col("name") == "<init>")
    rest = [c for c in calls.columns if c not in ("callee", "callstart")]
    one = inits.groupBy("callee").agg(F.min("callstart").alias("callstart"), F.max(F.struct("callend", *[c for c in rest if c != "callend"])).alias("last"))
    one = one.select("callee", "callstart", *[F.col(f"last.{c}").alias(c) for c in rest]).select(*calls.columns)
    return calls.filter(~F.coalesce(F.col("name") == "<init>", F.lit(False))).unionByName(one)


def objects(flat: DataFrame, late: DataFrame | None = None) -> DataFrame:
    """One row per constructed id: the last class (the dynamic one), the first site and thread."""
    born = flat.filter((F.col("kind") == "methodenter") & (F.col("name") == "<init>")).select(
        F.col("callee").alias("id"), F.regexp_replace("klass", "/", ".").alias("klass"), "sitefile", F.col("siteline").cast("int").alias("siteline"), "thread", "idx")
    if late is not None:
        born = born.unionByName(late)
    return born.groupBy("id").agg(
        F.max_by("klass", "idx").alias("klass"), F.min_by("sitefile", "idx").alias("allocationsitefile"),
        F.min_by("siteline", "idx").alias("allocationsiteline"), F.min_by("thread", "idx").alias("thread"))


def last_usages(objs: DataFrame, used: DataFrame) -> DataFrame:
    span = used.groupBy(F.col("callee").alias("id")).agg(F.min("idx").alias("firstusage"), F.max("idx").alias("lastusage"))
    return objs.drop("firstusage", "lastusage").join(span, "id", "left").select("id", "klass", "allocationsitefile", "allocationsiteline", "firstusage", "lastusage", "thread")


def broken_rows(t: dict[str, DataFrame]) -> DataFrame:
    """Rows that violate an invariant: where, why, and the row as JSON. They are reported, loading goes on."""
    zero = "coalesce(caller, 0) = 0 or coalesce(callee, 0) = 0"
    kinds = lambda allowed: "coalesce(kind, '') not in ({})".format(", ".join(map(repr, allowed)))
    blank = lambda column: f"coalesce({column}, '') = ''"
    rules = {
        "uses": {"zero id": zero, "unknown kind": kinds(USE_KINDS), "no place": "coalesce(idx, 0) <= 0", "empty name": blank("name"), "no method": blank("method"), "no thread": blank("thread")},
        "refs": {"zero id": zero, "unknown kind": kinds(REF_KINDS), "no start": "coalesce(refstart, 0) <= 0", "empty name": blank("name")},
        "calls": {"zero id": zero, "no start": "coalesce(callstart, 0) <= 0", "empty name": blank("name"), "ends too early": "callend < callstart"},
        "objects": {"zero id": "coalesce(id, 0) = 0", "no site": "allocationsitefile is null", "no thread": "thread is null"},
    }
    found = None
    for name, checks in rules.items():
        why = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(label)) for label, rule in checks.items()]))
        rows = t[name].withColumn("_why", why).filter("size(_why) > 0").select(F.lit(name).alias("place"), F.array_join("_why", ", ").alias("why"), F.to_json(F.struct(*t[name].columns)).alias("row"))
        found = rows if found is None else found.unionByName(rows)
    return found


def load(events: DataFrame, include_late_init: bool = False, null_store_closes: bool = False, chunk: int = CHUNK) -> dict[str, DataFrame]:
    """The store tables of an event DataFrame (see ``model.EVENTS``), and ``quarantine``: exits on an empty stack."""
    flat = relevant(flatten(events), include_late_init)
    deep = with_depth(flat.filter(F.col("kind").isin("methodenter", "methodexit", "varstore", "readmodify")), chunk)
    frames, framed = in_frames(deep, chunk)
    late_objects, refs = None, field_refs(flat, null_store_closes, chunk).unionByName(var_refs(framed, chunk))
    if include_late_init:
        late = flat.filter(F.col("kind") == "lateinit")
        late_objects = late.select(F.col("callee").alias("id"), F.regexp_replace("klass", "/", ".").alias("klass"), F.lit("<jvm internals>").alias("sitefile"), F.lit(-1).alias("siteline"), F.lit("late initialisation").alias("thread"), "idx")
        fields = late.select(F.col("callee").alias("caller"), F.explode("fields").alias("f")).filter("f.val != 0")
        refs = refs.unionByName(fields.select("caller", F.col("f.val").alias("callee"), F.lit("field").alias("kind"), F.col("f.name").alias("name"), F.lit(1).cast("long").alias("refstart"), F.lit(None).cast("long").alias("refend"), F.lit("late initialisation").alias("thread")))
    used = uses(flat, framed)
    out = {"uses": used, "refs": refs, "calls": collapse_constructors(raw_calls(frames)), "objects": last_usages(objects(flat, late_objects), used)}
    out = {k: v.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[k].fields]) for k, v in out.items()}
    out["quarantine"] = deep.filter("underflow").select("idx", "thread", "name", "klass")
    return out
