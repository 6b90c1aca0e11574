"""Hand-written event traces."""

from tracelens.model import EVENTS


def enter(name, tag, klass="C", thread="main", file="C.java", line=1):
    return "methodenter", {"name": name, "calleeclass": klass, "calleetag": tag, "signature": "()V", "threadName": thread, "callsitefile": file, "callsiteline": line}


def leave(name, klass="C", thread="main"):
    return "methodexit", {"name": name, "cname": klass, "threadName": thread}


def store(holder, field, val, caller=4, thread="main", old=0, method="m"):
    return "fieldstore", {"holderclass": "C", "holdertag": holder, "newval": val, "oldval": old, "fname": field, "type": "D", "callermethod": method, "callerclass": "C", "callertag": caller, "threadName": thread}


def load(holder, field, val, caller=4, thread="main"):
    return "fieldload", {"holderclass": "C", "holdertag": holder, "val": val, "fname": field, "type": "D", "callermethod": "m", "callerclass": "C", "callertag": caller, "threadName": thread}


def var(caller, slot, val, thread="main", method="m"):
    return "varstore", {"callermethod": method, "callerclass": "C", "callertag": caller, "newval": val, "oldval": 0, "var": slot, "threadName": thread}


def varload(caller, slot, val, thread="main"):
    return "varload", {"callermethod": "m", "callerclass": "C", "callertag": caller, "val": val, "var": slot, "threadName": thread}


def touch(tag, modify, field="x", caller=4, thread="main"):
    return "readmodify", {"isModify": modify, "calleeclass": "C", "calleetag": tag, "fname": field, "callerclass": "C", "callertag": caller, "threadName": thread}


def late(tag, **fields):
    return "lateinit", {"calleetag": tag, "calleeclass": "a/b/C", "fields": [{"name": k, "val": v} for k, v in fields.items()]}


def frame(spark, events):
    return spark.createDataFrame([{"idx": i, "kind": k, k: v} for i, (k, v) in enumerate(events, 1)], EVENTS)
