"""User protocols at rest and as streams, against a plain state machine."""

import json
import random

import pytest

from tests import traces as T
from tracelens.operators import loader, protocols
from tracelens.streaming import protocols as live


def random_trace(seed, n=300):
    rng, stacks, out, born = random.Random(seed), {"a": [], "b": []}, [], []
    for _ in range(n):
        t = rng.choice("ab")
        what = rng.random()
        if what < 0.38:
            name = rng.choice(["<init>", "run"])
            tag = 100 + len(born) if name == "<init>" and rng.random() < 0.8 else rng.choice(born or [99])
            born += [tag] if name == "<init>" else []
            stacks[t].append(name)
            out.append(T.enter(name, tag, klass=f"C{tag % 2}", thread=t))
        elif what < 0.7:
            out.append(T.leave(stacks[t].pop() if stacks[t] else "run", thread=t))
        elif what < 0.85:
            out.append(T.store(rng.choice(born[-4:] or [99]), "f", rng.choice(born or [0]), thread=t))
        else:
            out.append(T.touch(rng.choice(born[-4:] or [99]), rng.random() < 0.5, thread=t))
    return out


def brute(events, p, wants):
    stacks, states, out = {}, {}, {}
    for idx, (kind, f) in enumerate(events, 1):
        stack = stacks.setdefault(f["threadName"], [])
        frames = [dict(idx=i, callee=c, name=n, klass=k) for i, c, n, k in reversed(stack[-p.depth :])] if p.depth else []
        if kind == "methodenter":
            tag = f["calleetag"]
            if f["name"] == "<init>" and tag not in states:
                states[tag], out[tag] = p.start({"klass": f["calleeclass"], "frames": frames}), (True, None)
            stack.append((idx, tag, f["name"], f["calleeclass"]))
        elif kind == "methodexit":
            if stack:
                stack.pop()
        else:
            tag = f.get("holdertag", f.get("calleetag"))
            if tag in states and out[tag][0] and wants(kind, f):
                now = p.step(states[tag], {"frames": frames, "idx": idx})
                if now is protocols.FAILED:
                    out[tag] = (False, idx)
                else:
                    states[tag] = now
    return out


WANTS = {"class_private": lambda k, f: k == "fieldstore" or f["isModify"], "near_creator": lambda k, f: True}


@pytest.mark.parametrize("name", sorted(WANTS))
def test_verdicts(spark, name):
    events = random_trace(1)
    want = brute(events, protocols.REGISTERED[name], WANTS[name])
    got = protocols.verdicts(loader.flatten(T.frame(spark, events)), protocols.REGISTERED[name], chunk=40)
    assert {r["id"]: (r["ok"], r["at"]) for r in got.collect()} == want
    assert {ok for ok, _ in want.values()} == {True, False}
    assert protocols.verdicts(loader.flatten(T.frame(spark, events)).filter("false"), protocols.REGISTERED[name]).count() == 0


def test_stream_gives_the_verdicts_and_drops_states(spark, tmp_path):
    """Three batches; states end with failures and with the event marked as an object's last."""
    events = random_trace(2, 240)
    p = protocols.REGISTERED["class_private"]
    last = {}
    for i, (kind, f) in enumerate(events, 1):
        for tag in [f.get("holdertag", f.get("calleetag"))] if kind != "methodexit" else []:
            last[tag] = i
    flat = loader.flatten(T.frame(spark, events)).cache()
    (tmp_path / "in").mkdir()
    marks = ", ".join(map(str, sorted(set(last.values()))))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got, held = {}, []
    try:
        stream = live.verdicts(spark.readStream.schema(flat.schema).parquet(str(tmp_path / "in")), p, f"idx in ({marks})")
        for lo in (0, 80, 160):
            flat.filter(f"idx > {lo} and idx <= {lo + 80}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            query = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(
                lambda df, _: got.update({r["id"]: (r["ok"], r["at"]) for r in df.collect()})).start()
            query.awaitTermination()
            progress = json.loads(query.lastProgress.json) if hasattr(query.lastProgress, "json") else query.lastProgress
            # the operators are listed from the last to the first
            held.append(progress["stateOperators"][0]["numRowsTotal"])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == brute(events, p, WANTS["class_private"])
    assert held[-1] == 0 and held[0] > 0
