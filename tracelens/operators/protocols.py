"""User protocols: one state machine per constructed object, which sees the object's events and the frames around them.

A protocol says how many frames it looks at and which events it wants (SQL over the event, so others never reach Python). Its state begins
when the object is constructed; ``step`` gives the state after an event, or ``FAILED``. Objects that fail are out at once. The same
protocol runs over a trace at rest (``verdicts``) and over a stream (``streaming.protocols``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.model import arrow_schema
from tracelens.operators import loader
from tracelens.operators.scans import CHUNK, running
from tracelens.plans.cutting import Scratch, cut, work_path

#: What ``step`` returns for an object that breaks the protocol.
FAILED = object()

FRAME = "struct<idx:long,callee:long,name:string,klass:string>"
#: An event as a protocol sees it, once for each object that it concerns.
SEEN = f"id long, role string, idx long, kind string, thread string, name string, klass string, callee long, caller long, val long, is_modify boolean, born boolean, ends boolean, wanted boolean, frames array<{FRAME}>"
_COLUMNS = [c.split()[0] for c in SEEN.split(", ")]
VERDICTS = "id long, ok boolean, at long"


@dataclass(frozen=True)
class Protocol:
    """``wants``: condition over kind, role (callee, caller, val: how the event names the object), name, is_modify.

    ``start(event)`` gives the state at construction, where the frames are those of the constructor's caller; ``step(state, event)`` the next
    state or ``FAILED``. States must survive JSON (lists, dicts, strings, numbers). ``frames`` of an event, a list of dicts, has the
    ``depth`` topmost frames of the thread's stack, the top first; fewer where the stack is lower.
    """

    depth: int
    wants: str
    start: Callable[[dict], object]
    step: Callable[[object, dict], object]


def with_frames(flat: DataFrame, depth: int, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """``flat`` with ``frames``: the ``depth`` topmost frames around each event, the top first. An entering event sees its caller's
    frames, a leaving one the frame that it leaves. Looked up per (thread, level) in chunks, so one busy thread or level is no
    single task."""
    deep = scratch.cut(loader.with_depth(flat, chunk), "deep")
    enter, leave = F.col("kind") == "methodenter", (F.col("kind") == "methodexit") & ~F.col("underflow")
    own = F.when(enter, F.col("depth") - 1).when(leave, F.col("depth") + 1).otherwise(F.col("depth"))
    event = F.struct(*flat.columns)
    asks = deep.select("thread", "idx", event.alias("event"), F.posexplode(F.sequence(own, own - (depth - 1))).alias("place", "level"))
    asks = asks.filter("level > 0 or place = 0").withColumn("frame", F.lit(None).cast(FRAME))
    facts = deep.filter(enter).select("thread", "idx", F.lit(None).cast(deep.select(event.alias("e")).schema["e"].dataType).alias("event"), F.lit(-1).alias("place"), F.col("depth").alias("level"), F.struct("idx", "callee", "name", "klass").cast(FRAME).alias("frame"))
    found = running(facts.unionByName(asks), ["thread", "level"], "around", F.col("frame"), chunk=chunk).filter("place >= 0")
    found = found.withColumn("around", F.when(F.col("level") > 0, F.col("around")))
    each = found.groupBy("idx").agg(F.first("event").alias("event"), F.array_sort(F.collect_list(F.when(F.col("around").isNotNull(), F.struct("place", "around")))).alias("by_place"))
    return each.select("event.*", F.transform("by_place", lambda x: x["around"]).alias("frames"))


def concerned(framed: DataFrame, ends: str = "false") -> DataFrame:
    """One row for each object that an event names. ``born`` marks the construction, ``ends`` (SQL) the last event of an object."""
    roles = F.array_compact(F.array(*[F.when(F.col(c) > 4, F.struct(F.col(c).alias("id"), F.lit(c).alias("role"))) for c in ("callee", "caller", "val")]))
    born = (F.col("kind") == "methodenter") & (F.col("name") == "<init>") & (F.col("role") == "callee")
    out = framed.withColumn("_role", F.explode(roles)).withColumn("id", F.col("_role.id")).withColumn("role", F.col("_role.role"))
    return out.withColumn("born", F.coalesce(born, F.lit(False))).withColumn("ends", F.coalesce(F.expr(ends), F.lit(False)))


def wanted(seen: DataFrame, p: Protocol) -> DataFrame:
    """The rows of ``concerned`` that the protocol's machine has to see, as ``SEEN``."""
    return seen.withColumn("wanted", F.coalesce(F.expr(p.wants), F.lit(False))).filter("born or ends or wanted").select(*_COLUMNS)


def machine(p: Protocol, state: list | None, event: dict) -> tuple[list | None, bool | None]:
    """(state after the event, verdict or None): what tables and streams share. The state is None before construction and after the
    end, [x] for a living object and [] for one that failed, of which nothing else is kept. Later constructor calls of a chain change nothing."""
    verdict = None
    if state is None:
        state = [p.start(event)] if event["born"] else None
    elif state and event["wanted"] and not event["born"]:
        now = p.step(state[0], event)
        state, verdict = ([], False) if now is FAILED else ([now], None)
    if event["ends"]:
        return None, True if state else verdict
    return state, verdict


def verdicts(flat: DataFrame, p: Protocol, chunk: int = CHUNK) -> DataFrame:
    """id, ok, at (idx of the event that broke the protocol) of every constructed object of flat events (see ``loader.flatten``).

    An object's wanted events are sorted in one task, as any state machine asks for; frames come from two-level scans.
    """
    spark = flat.sparkSession
    columns = [c for c in ("idx", "kind", "thread", "name", "klass", "callee", "caller", "val", "is_modify") if c in flat.columns]
    out = arrow_schema(VERDICTS)

    def run(batches):
        import pyarrow as pa

        id_, state, found = None, None, []

        def closed():
            return [{"id": id_, "ok": True, "at": None}] if state else []

        for batch in batches:
            for event in batch.to_pylist():
                if event["id"] != id_:
                    found += closed()
                    id_, state = event["id"], None
                state, verdict = machine(p, state, event)
                if verdict is not None:
                    found.append({"id": id_, "ok": verdict, "at": None if verdict else event["idx"]})
            if found:
                yield pa.RecordBatch.from_pylist(found, out)
                found = []
        if found := found + closed():
            yield pa.RecordBatch.from_pylist(found, out)

    with Scratch(spark, "protocol") as scratch:
        seen = wanted(concerned(with_frames(flat.select(*columns), p.depth, scratch, chunk)), p)
        # an object's construction comes before what else the same event says of it
        ordered = seen.repartition("id").sortWithinPartitions("id", "idx", F.col("born").desc(), "role")
        return cut(ordered.mapInArrow(run, VERDICTS), work_path(spark, "verdicts"))


# ---- protocols that need the stack

#: Fields are only written while a method of the object's own class is on top of the stack.
CLASS_PRIVATE = Protocol(
    depth=1, wants="role = 'callee' and (kind = 'fieldstore' or (kind = 'readmodify' and is_modify))",
    start=lambda e: e["klass"], step=lambda klass, e: klass if e["frames"] and e["frames"][0]["klass"] == klass else FAILED)


def _creator(e: dict):
    return e["frames"][0]["idx"] if e["frames"] else None


#: An object's fields are only used by the call that constructed it and by calls made directly from there. What is constructed on an empty
#: stack may be used on an empty stack only.
NEAR_CREATOR = Protocol(
    depth=2, wants="role = 'callee' and kind in ('fieldstore', 'fieldload', 'readmodify')", start=_creator,
    step=lambda at, e: at if (at is None and not e["frames"]) or at in [f["idx"] for f in e["frames"]] else FAILED)

REGISTERED = {"class_private": CLASS_PRIVATE, "near_creator": NEAR_CREATOR}
