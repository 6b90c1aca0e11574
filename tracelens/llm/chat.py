"""6 Chat formatting: a finite-state machine over roles, and a declarative template with loss flags.

``TEMPLATE`` says for each role which control strings open and close a turn and whether its text is under
the loss mask. The machine in ``TRANSITIONS`` walks the roles in turn order and names the first turn that
breaks it; such conversations are formatted too and marked ``valid = false``. Control strings inside texts
get one backslash after their first character (one more, if some are there already), so the formatted
string has control strings only where the template put them and reads back exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import blank, sha_hex, table

#: role -> (opening control strings, closing control strings, text under the loss mask)
TEMPLATE: dict[str, tuple[str, str, bool]] = {
    "system": ("[SYS] ", " [/SYS]\n", False),
    "user": ("[INST] ", " [/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
#: Any other role: opening, between its name and its text, closing.
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
#: state -> role -> state; a missing entry is a violation. Any state in ENDS may end a conversation.
TRANSITIONS: dict[str, dict[str, str]] = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
}
ENDS = ("assistant",)
PROBE_TEXT = "</s>[INST] ok [/INST]"


def controls() -> list[str]:
    parts = [s for o, c, _ in TEMPLATE.values() for s in (o, c)] + list(OTHER)
    return sorted({s.strip() for s in parts})


def _rests(first: str) -> str:
    return "|".join(re.escape(s[1:]) for s in controls() if s[0] == first)


_FIRSTS = sorted({s[0] for s in controls()})
#: The empty place after the first character of a control string that may hold backslashes there already.
ESCAPE = "|".join(rf"(?<={re.escape(c)})(?=\\*(?:{_rests(c)}))" for c in _FIRSTS)
#: The first of these backslashes.
UNESCAPE = "|".join(rf"(?<={re.escape(c)})\\(?=\\*(?:{_rests(c)}))" for c in _FIRSTS)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "")


def _by_role(role: Column, part: int, other: Column) -> Column:
    out = other
    for name, spec in TEMPLATE.items():
        out = F.when(role == name, F.lit(spec[part])).otherwise(out)
    return out


def segments(turn: Column) -> Column:
    """The text segments of one turn: array of (text, loss)."""
    role = turn["role"]
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    return F.array(
        seg(_by_role(role, 0, F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]))), no),
        seg(escaped(turn["text"]), _by_role(role, 2, no).cast("boolean")),
        seg(_by_role(role, 1, F.lit(OTHER[2])), no),
    )


def _machine(turns: Column) -> Column:
    """(state, first turn that breaks the order or null) after the last turn."""
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))
    steps = F.create_map(*[F.lit(x) for s, to in TRANSITIONS.items() for r, t in to.items() for x in (f"{s}>{r}", t)])

    def step(acc, turn):
        to = F.element_at(steps, F.concat(acc["state"], F.lit(">"), turn["role"]))
        return F.struct(
            F.coalesce(to, acc["state"]).alias("state"), (acc["at"] + 1).alias("at"),
            F.when(acc["bad"].isNull() & to.isNull(), acc["at"]).otherwise(acc["bad"]).alias("bad"),
        )

    return F.aggregate(turns, start, step)


def format_chats(rows: DataFrame) -> DataFrame:
    """One row per conv_id: ``turns``, ``segments`` (text, loss), ``formatted``, ``valid``, ``first_bad_turn``.

    Turns are ordered by turn (null first), ties by role, then text; repeated rows stay. Null role and null
    text count as empty strings; null conv_id is a conversation of its own. An empty table gives no rows.
    A conversation must fit one row, since its formatted string is one value.
    """
    turns = rows.select("conv_id", F.struct(F.col("turn"), blank("role").alias("role"), blank("text").alias("text")).alias("t"))
    out = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    out = out.withColumn("segments", F.flatten(F.transform("turns", segments))).withColumn("_end", _machine(F.col("turns")))
    return out.select(
        "conv_id", "turns", "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("_end.bad").isNull() & F.col("_end.state").isin(*ENDS)).alias("valid"),
        F.col("_end.bad").alias("first_bad_turn"),
    )


_OPENS = [o for o, _, _ in TEMPLATE.values()] + [OTHER[0]]


def read_back(formatted: Column) -> Column:
    """The turns (role, text, loss) of a formatted string."""
    parts = F.filter(F.split(formatted, "(?=" + "|".join(re.escape(o) for o in _OPENS) + ")"), lambda p: p != "")

    def inner(p: Column, opening: str, closing: str) -> Column:
        return unescaped(F.substring(p, F.lit(len(opening) + 1), F.length(p) - len(opening) - len(closing)))

    def turn(p: Column) -> Column:
        body = F.substring(p, F.lit(len(OTHER[0]) + 1), F.length(p) - len(OTHER[0]) - len(OTHER[2]))
        cut = F.instr(body, OTHER[1])
        out = F.struct(
            unescaped(F.substring(body, F.lit(1), cut - 1)).alias("role"),
            unescaped(F.substring(body, cut + len(OTHER[1]), F.length(body))).alias("text"), F.lit(False).alias("loss"),
        )
        for name, (o, c, loss) in TEMPLATE.items():
            out = F.when(p.startswith(o), F.struct(F.lit(name).alias("role"), inner(p, o, c).alias("text"), F.lit(loss).alias("loss"))).otherwise(out)
        return out

    return F.transform(parts, turn)


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back from the formatted strings, as counts and digests."""
    back = chats.withColumn("_turns", read_back(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("_turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), sha_hex(whole).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), sha_hex(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"),
    )
    return digests(format_chats(rows.unionByName(probe)))


def _sql_escaped(x: str) -> str:
    """RE2 has no lookbehind: the first character is matched and put back."""
    for c in _FIRSTS:
        x = rf"regexp_replace({x}, '({re.escape(c)})(\\*(?:{_rests(c)}))', '\1\\\2', 'g')"
    return x


def _sql_case(part: int, other: str) -> str:
    whens = " ".join(f"WHEN role = '{r}' THEN {spec[part]!r}" if part == 2 else f"WHEN role = '{r}' THEN {len(spec[part])}" for r, spec in TEMPLATE.items())
    return f"CASE {whens} ELSE {other} END"


OP6_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE_TEXT}'),
m AS (SELECT *, {_sql_escaped('text')} AS e, lag(role) OVER w AS before, lead(role) OVER w IS NULL AS last FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
n AS (SELECT *, {_sql_case(0, f"{len(OTHER[0] + OTHER[1])} + length({_sql_escaped('role')})")} + length(e) + {_sql_case(1, str(len(OTHER[2])))} AS chars,
    CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'user' THEN role = 'assistant'
      WHEN before IN ('system', 'assistant') THEN role = 'user' ELSE false END AS ok FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(ok) AND bool_or(last AND role = 'assistant') AS valid
FROM n GROUP BY conv_id
"""
