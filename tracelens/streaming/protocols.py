"""User protocols over a stream of events: ``operators.protocols`` with state per thread and per object.

A first stage holds the call stack of each thread and gives every event its frames; a second one holds the state of each living object.
Events arrive in order of idx for each thread and object, across batches. A state is created at construction and dropped when the object
ends; the verdict comes out when the object fails, or else when it ends. Of one that failed only an empty state is kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StringType, StructField, StructType

from tracelens.operators.protocols import FRAME, VERDICTS, Protocol, concerned, machine, wanted

_STATE = StructType([StructField("json", StringType())])
_EVENT = ["idx", "kind", "thread", "name", "klass", "callee", "caller", "val", "is_modify"]
FRAMED = f"idx long, kind string, thread string, name string, klass string, callee long, caller long, val long, is_modify boolean, last boolean, frames array<{FRAME}>"


def _plain(events: dict) -> dict:
    """A row of a pandas frame with None for what is missing and integers as such."""
    return {k: None if v is None or (isinstance(v, float) and v != v) else (int(v) if isinstance(v, float) else v) for k, v in events.items()}


class Frames(StatefulProcessor):
    """Events with the frames around them. The state is the thread's stack, as [idx, callee, name, klass], oldest first."""

    def __init__(self, depth: int):
        self.depth = depth

    def init(self, handle) -> None:
        self.stack = handle.getValueState("stack", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        stack = json.loads(self.stack.get()[0]) if self.stack.exists() else []
        out = []
        for e in pd.concat(list(rows)).sort_values("idx").to_dict("records"):
            e = _plain(e)
            top = [dict(zip(("idx", "callee", "name", "klass"), f)) for f in reversed(stack[-self.depth :])]
            if e["kind"] == "methodenter":
                stack.append([e["idx"], e["callee"], e["name"], e["klass"]])
            elif e["kind"] == "methodexit" and stack:
                stack.pop()
            out.append({**e, "frames": top})
        self.stack.update((json.dumps(stack),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FRAMED.split(", ")]).astype({c: "Int64" for c in ("idx", "callee", "caller", "val")})

    def close(self) -> None:
        pass


class Objects(StatefulProcessor):
    """Verdicts. The state is that of the object's protocol; there is none before construction nor after the verdict."""

    def __init__(self, protocol: Protocol):
        self.protocol = protocol

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        held, out = state is not None, []
        for e in pd.concat(list(rows)).sort_values(["idx", "born", "role"], ascending=[True, False, True]).to_dict("records"):
            e = _plain(e) | {"frames": [_plain(dict(f)) for f in e["frames"]]}
            state, verdict = machine(self.protocol, state, e)
            if verdict is not None:
                out.append((key[0], verdict, None if verdict else e["idx"]))
        if state is not None:
            self.state.update((json.dumps(state),))
        elif held:
            self.state.clear()
        yield pd.DataFrame(out, columns=["id", "ok", "at"]).astype({"id": "Int64", "ok": "boolean", "at": "Int64"})

    def close(self) -> None:
        pass


def framed(flat: DataFrame, depth: int, last: str = "false") -> DataFrame:
    """A stream of flat events with their frames; ``last`` (SQL over the stream) marks events that end the object they are made on."""
    from pyspark.sql import functions as F

    rows = flat.withColumn("last", F.coalesce(F.expr(last), F.lit(False))).select(*_EVENT, "last")
    return rows.groupBy("thread").transformWithStateInPandas(Frames(depth), FRAMED, "Append", "None")


def verdicts(flat: DataFrame, p: Protocol, last: str = "false") -> DataFrame:
    """id, ok, at of the objects that failed or ended, as soon as they do. Needs the RocksDB state store."""
    seen = wanted(concerned(framed(flat, p.depth, last), "last and role = 'callee'"), p)
    return seen.groupBy("id").transformWithStateInPandas(Objects(p), VERDICTS, "Append", "None")
