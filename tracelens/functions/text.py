"""Events and results as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _line(*parts) -> Column:
    """Texts and columns in a row; null shows as nothing."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def event_text() -> Column:
    """One line for an event of the ``model.EVENTS`` schema. The wording is fixed: readers of listings rely on it."""
    me, mx, fs, fl = F.col("methodenter"), F.col("methodexit"), F.col("fieldstore"), F.col("fieldload")
    vs, vl, rm, li = F.col("varstore"), F.col("varload"), F.col("readmodify"), F.col("lateinit")
    pairs = F.transform(li["fields"], lambda f: _line(f["name"], " = ", f["val"], " "))
    by_kind = {
        "methodenter": _line("==>  (", me["calleeclass"], " @ ", me["calleetag"], ") . ", me["name"], me["signature"], " , callsite=", me["callsitefile"], ":", me["callsiteline"], " , thread=", me["threadName"]),
        "methodexit": _line("<== (??? @ ", mx["cname"], ") . ", mx["name"], "(???), thread=", mx["threadName"]),
        "fieldstore": _line("fieldStore - caller=", fs["callerclass"], " :: ", fs["callermethod"], " @ ", fs["callertag"], " , holder=", fs["holderclass"], " @ ", fs["holdertag"],
            " , field=", fs["type"], " ", fs["fname"], " , value= was ", fs["oldval"], " , is ", fs["newval"], " , thread=", fs["threadName"]),
        "fieldload": _line("fieldLoad - caller=", fl["callerclass"], " :: ", fl["callermethod"], " @ ", fl["callertag"], " , holder=", fl["holderclass"], " @ ", fl["holdertag"],
            " , field=", fl["type"], " ", fl["fname"], " , thread=", fl["threadName"]),
        "varstore": _line("varstore - caller=", vs["callerclass"], " :: ", vs["callermethod"], " @ ", vs["callertag"], " var ", vs["var"], " , value was ", vs["oldval"], " , now is ", vs["newval"], " , thread=", vs["threadName"]),
        "varload": _line("varload - caller=", vl["callerclass"], " @ ", vl["callertag"], " , var ", vl["var"], " , val=", vl["val"], " , thread=", vl["threadName"]),
        "readmodify": _line("readmodify - callee=", rm["calleeclass"], " @ ", rm["calleetag"], " , caller=", rm["callerclass"], " @ ", rm["callertag"], F.when(rm["isModify"], " writes ").otherwise(" reads "), rm["fname"]),
        "lateinit": _line("lateInitialisation - callee=", li["calleeclass"], " @ ", li["calleetag"], " [ ", F.array_join(pairs, ""), "]"),
    }
    out = F.lit("<unknown event kind>")
    for kind, text in by_kind.items():
        out = F.when(F.col("kind") == kind, text).otherwise(out)
    return out


def listing(events: DataFrame) -> DataFrame:
    """idx, line: ``#n: <event>``."""
    return events.select("idx", F.concat(F.lit("#"), F.col("idx").cast("string"), F.lit(": "), event_text()).alias("line"))


def shorten(text: str, width: int = 30) -> str:
    """At most about ``width`` characters, with the middle left out."""
    half = width // 2 - 1
    return text if len(text) <= width else f"{text[:half]}..{text[-half:]}"


def fixed(text: str, width: int = 30) -> str:
    return shorten(text, width).ljust(width) if len(text) < width else shorten(text, width)


def shown(df: DataFrame, max_rows: int = 10) -> str:
    """A table of the first rows and the total number."""
    rows, total = df.limit(max_rows).collect(), df.count()
    lines = ["|" + "".join(fixed(c).upper() + "\t|\t" for c in df.columns)]
    lines += ["|" + "".join(fixed(str(v)) + "\t|\t" for v in r) for r in rows]
    return "\n".join([*lines, *["..."] * (total > len(rows)), f"TOTAL: {total} rows selected"])


def bar(value: Column, width: int = 70) -> Column:
    """A text bar: the value against the next power of ten."""
    scale = F.pow(F.lit(10.0), F.ceil(F.log10(F.greatest(value, F.lit(1)).cast("double"))))
    return F.repeat(F.lit("#"), F.floor(value / F.greatest(scale, F.lit(1.0)) * width).cast("int"))
