"""Schemas and constants of traces and stores."""

from __future__ import annotations

from pyspark.sql import types as T

#: The JVM's own object; ids below are null (0) or class representatives (negative).
JVM = 4

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


EVENT_FIELDS = {
    "methodenter": _struct(name=_S, calleeclass=_S, calleetag=_L, signature=_S, threadName=_S, callsitefile=_S, callsiteline=_L),
    "methodexit": _struct(name=_S, cname=_S, threadName=_S),
    "fieldstore": _struct(holderclass=_S, holdertag=_L, newval=_L, oldval=_L, fname=_S, type=_S, callermethod=_S, callerclass=_S, callertag=_L, threadName=_S),
    "lateinit": _struct(calleetag=_L, calleeclass=_S, fields=T.ArrayType(_struct(name=_S, val=_L))),
    "fieldload": _struct(holderclass=_S, holdertag=_L, val=_L, fname=_S, type=_S, callermethod=_S, callerclass=_S, callertag=_L, threadName=_S),
    "varstore": _struct(callermethod=_S, callerclass=_S, callertag=_L, newval=_L, oldval=_L, var=T.ByteType(), threadName=_S),
    "varload": _struct(callermethod=_S, callerclass=_S, callertag=_L, val=_L, var=T.ByteType(), threadName=_S),
    "readmodify": _struct(isModify=T.BooleanType(), calleeclass=_S, calleetag=_L, fname=_S, callerclass=_S, callertag=_L, threadName=_S),
}
#: L0: one row per event, its place in the trace from 1, and one filled struct.
EVENTS = T.StructType([T.StructField("idx", _L), T.StructField("kind", _S)] + [T.StructField(k, v) for k, v in EVENT_FIELDS.items()])

OBJECTS = _struct(id=_L, klass=_S, allocationsitefile=_S, allocationsiteline=_I, firstusage=_L, lastusage=_L, thread=_S)
REFS = _struct(caller=_L, callee=_L, kind=_S, name=_S, refstart=_L, refend=_L, thread=_S)
CALLS = _struct(caller=_L, callee=_L, name=_S, callstart=_L, callend=_L, callsitefile=_S, callsiteline=_L, thread=_S)
USES = _struct(caller=_L, callee=_L, name=_S, method=_S, kind=_S, idx=_L, thread=_S)
CLASSDUMPS = _struct(classname=_S, bytecode=T.BinaryType())
META = _struct(key=_S, val=_S)
TABLES = {"objects": OBJECTS, "refs": REFS, "calls": CALLS, "uses": USES, "classdumps": CLASSDUMPS, "meta": META}

USE_KINDS = ("fieldstore", "fieldload", "varstore", "varload", "read", "modify")
READS, WRITES = ("fieldload", "read"), ("fieldstore", "modify")
REF_KINDS = ("field", "var")


def arrow_schema(ddl: str):
    """The Arrow schema of a DDL string; made on the driver, for functions that give Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))
