"""The loader's call stacks over a stream of events.

Each thread is a key; its state is its stack, and events of a micro-batch are taken in order of idx. Rows come out as soon as
they are final: a use at its event, a call and the variable edges of a frame at its exit, a variable edge when its slot is stored to.
Field edges need the next store to the same field and are made from the stored ``fieldstore`` uses by the batch
functions. A trace is totally ordered, so nothing is ever late; events must arrive with each thread's in order across batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from tracelens.model import JVM
from tracelens.operators.loader import UNKNOWN_METHOD

OUT = "place string, caller long, callee long, name string, method string, kind string, start long, end long, sitefile string, siteline long, thread string"


class StackMachine:
    """State: frames, oldest first: [name, callee, idx, file, line, {slot: [start, holder, value]}]."""

    def __init__(self, frames: list | None = None):
        self.frames = frames or []

    def step(self, e: dict) -> Iterator[tuple]:
        """Output rows (see ``OUT``, without the thread) that this event completes."""
        kind, idx = e["kind"], int(e["idx"])
        top = self.frames[-1] if self.frames else None
        if kind == "methodenter":
            self.frames.append([e["name"], _int(e["callee"]), idx, e["sitefile"], _int(e["siteline"]), {}])
        elif kind == "methodexit":
            if top is None:
                yield ("quarantine", None, None, e["name"], None, kind, idx, None, None, None)
                return
            self.frames.pop()
            if top[0] == e["name"]:
                below = self.frames[-1][1] if self.frames else JVM
                yield ("calls", below, top[1], top[0], None, None, top[2], idx, top[3], top[4])
                for slot, (start, holder, value) in sorted(top[5].items()):
                    yield ("refs", holder, value, f"var_{slot}", None, "var", start, idx, None, None)
            else:
                yield from self.open_edges(top)
        elif kind == "readmodify":
            yield ("uses", _int(e["caller"]), _int(e["callee"]), e["name"], top[0] if top else UNKNOWN_METHOD, "modify" if e["is_modify"] else "read", idx, None, None, None)
        elif kind in ("varload", "varstore"):
            slot = str(_int(e["var"]))
            yield ("uses", _int(e["caller"]), _int(e["caller"]), f"var_{slot}", e["callermethod"], kind, idx, None, None, None)
            if kind == "varstore":
                value = _int(e["val"])
                if top is None:
                    if value:
                        yield ("refs", _int(e["caller"]), value, f"var_{slot}", None, "var", idx, None, None, None)
                    return
                if slot in top[5]:
                    start, holder, old = top[5].pop(slot)
                    yield ("refs", holder, old, f"var_{slot}", None, "var", start, idx, None, None)
                if value:
                    top[5][slot] = [idx, _int(e["caller"]), value]
        elif kind in ("fieldload", "fieldstore"):
            yield ("uses", _int(e["caller"]), _int(e["callee"]), e["name"], e["callermethod"], kind, idx, None, None, None)

    def open_edges(self, frame) -> Iterator[tuple]:
        for slot, (start, holder, value) in sorted(frame[5].items()):
            yield ("refs", holder, value, f"var_{slot}", None, "var", start, None, None, None)


def _int(v):
    return None if v is None or v != v else int(v)


def _run(key, frames, state):
    import pandas as pd

    machine = StackMachine(json.loads(state.get[0]) if state.exists else [])
    events = pd.concat(list(frames)).sort_values("idx")
    rows = [(*r, key[0]) for e in events.to_dict("records") for r in machine.step(e)]
    state.update((json.dumps(machine.frames),))
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")]).astype({c: "Int64" for c in ("caller", "callee", "start", "end", "siteline")})


def stack_rows(flat: DataFrame) -> DataFrame:
    """Rows of calls, uses and variable edges from a stream of flat, relevant events (``loader.relevant(loader.flatten(..))``).
    Works on streams only; for tables at rest ``loader.load`` gives the same rows by windows."""
    columns = ["idx", "kind", "name", "callee", "caller", "callermethod", "val", "var", "is_modify", "sitefile", "siteline", "thread"]
    return flat.select(*columns).groupBy("thread").applyInPandasWithState(_run, OUT, "frames string", "append", GroupStateTimeout.NoTimeout)
