"""Registered queries over the trace-shaped views, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens import views
from tracelens.operators import loader, objects, stats
from tracelens.plans.compiler import Compiler
from tracelens.plans.dominators import heap_dominators

_WRITES, _READS = "kind IN ('fieldstore', 'modify')", "kind IN ('fieldload', 'read')"
MUTABLE = f"SELECT DISTINCT callee AS id FROM uses WHERE callee > 4 AND {_WRITES} AND NOT (caller = callee AND method = '<init>')"
NTL = "SELECT callee AS id FROM uses WHERE callee > 4 GROUP BY callee HAVING COUNT(DISTINCT thread) > 1"
NON_STATIONARY = f"SELECT DISTINCT r.callee AS id FROM uses r JOIN uses w ON r.callee = w.callee AND w.idx > r.idx WHERE r.callee > 4 AND r.{_READS} AND w.{_WRITES}"
_ALL = "SELECT id FROM objects WHERE id > 4"
AGE = "SELECT o.id AS id, o.firstusage AS firstusage, c.firstusage AS calleefirstusage FROM refs JOIN objects o ON o.id = caller JOIN objects c ON c.id = callee WHERE kind = 'field'"


def _unique(where: str) -> str:
    return f"""SELECT callee AS id FROM (SELECT callee, SUM(delta) OVER (PARTITION BY callee ORDER BY time NULLS LAST) AS open FROM (
  SELECT callee, refstart AS time, 1 AS delta FROM refs WHERE {where} UNION ALL SELECT callee, refend, -1 FROM refs WHERE {where}) d WHERE callee > 4) s
 GROUP BY callee HAVING MAX(open) = 1"""


def _closure(seed: str, backwards: bool, heap: bool, name: str = "reach") -> str:
    src, dst = ("callee", "caller") if backwards else ("caller", "callee")
    return f"{name}(id) AS ({seed} UNION SELECT {dst} FROM refs JOIN {name} ON {src} = id{' WHERE kind = ' + repr('field') if heap else ''})"


def _perc(part: str, total: str) -> str:
    n = f"(20000 * ({part}) + ({total}))"
    return f"CAST({n} - {n} % (2 * ({total})) AS DOUBLE) / (2 * ({total})) / 100"


def _not(inner: str) -> str:
    return f"{_ALL} EXCEPT ({inner})"


def _deeply(inner: str, heap: bool) -> tuple[str, ...]:
    return (f"SELECT id FROM ({inner}) a EXCEPT SELECT id FROM reach", _closure(f"SELECT id FROM ({_not(inner)}) n", True, heap))


_MUT_FROM = "SELECT DISTINCT {to} AS id FROM refs WHERE {at} IN (" + MUTABLE + "){heap}"
_HEAP = " AND kind = 'field'"

#: name -> (query text, oracle body, further named sub-queries)
TEXT: dict[str, tuple] = {
    "obj": ("Obj()", "SELECT id FROM objects WHERE id >= 4"),
    "instance_of": ("InstanceOf(app.Cart)", "SELECT id FROM objects WHERE klass = 'app.Cart'"),
    "allocated_at": ("AllocatedAt(App.java:17)", "SELECT id FROM objects WHERE allocationsitefile = 'App.java' AND allocationsiteline = 17"),
    "const_set": ("And(Obj() Set(4 16 27 136 136 5))", "SELECT id FROM objects WHERE id >= 4 AND id IN (4, 16, 27, 136, 5)"),
    "mutable_obj": ("MutableObj()", MUTABLE),
    "immutable_obj": ("ImmutableObj()", _not(MUTABLE)),
    "thread_local_obj": ("ThreadLocalObj()", _not(NTL)),
    "stationary_obj": ("StationaryObj()", _not(NON_STATIONARY)),
    "unique_obj": ("UniqueObj()", _unique("true")),
    "heap_unique_obj": ("HeapUniqueObj()", _unique("kind = 'field'")),
    "stack_bound_obj": ("StackBoundObj()", f"{_ALL} AND NOT EXISTS (SELECT 1 FROM refs WHERE callee = id AND kind = 'field')"),
    "tiny_obj": ("TinyObj()", "SELECT id FROM objects WHERE id >= 4 EXCEPT SELECT caller FROM refs WHERE kind = 'field'"),
    "age_ordered_obj": ("AgeOrderedObj()", f"SELECT id FROM ({AGE}) a GROUP BY id, firstusage HAVING MAX(calleefirstusage) < firstusage"),
    "reverse_age_ordered_obj": ("ReverseAgeOrderedObj()", f"SELECT id FROM ({AGE}) a GROUP BY id, firstusage HAVING MAX(calleefirstusage) > firstusage"),
    "and_query": ("And(MutableObj() Not(ThreadLocalObj()))", f"{MUTABLE} INTERSECT ({_not(f'({_not(NTL)})')})"),
    "or_query": ("Or(MutableObj() StackBoundObj())", f"{MUTABLE} UNION ({_ALL} AND NOT EXISTS (SELECT 1 FROM refs WHERE callee = id AND kind = 'field'))"),
    "not_query": ("Not(InstanceOf(app.Cart))", _not("SELECT id FROM objects WHERE klass = 'app.Cart'")),
    "refers_to": ("RefersTo(MutableObj())", _MUT_FROM.format(to="caller", at="callee", heap="")),
    "heap_refers_to": ("HeapRefersTo(MutableObj())", _MUT_FROM.format(to="caller", at="callee", heap=_HEAP)),
    "referred_from": ("ReferredFrom(MutableObj())", _MUT_FROM.format(to="callee", at="caller", heap="")),
    "heap_referred_from": ("HeapReferredFrom(MutableObj())", _MUT_FROM.format(to="callee", at="caller", heap=_HEAP)),
    "reachable_from": ("ReachableFrom(Not(ThreadLocalObj()))", "SELECT id FROM reach", _closure(f"SELECT id FROM ({_not(f'({_not(NTL)})')}) n", False, False)),
    "heap_reachable_from": ("HeapReachableFrom(Not(ThreadLocalObj()))", "SELECT id FROM reach", _closure(f"SELECT id FROM ({_not(f'({_not(NTL)})')}) n", False, True)),
    "can_reach": ("CanReach(MutableObj())", "SELECT id FROM reach", _closure(MUTABLE, True, False)),
    "can_heap_reach": ("CanHeapReach(Not(ThreadLocalObj()))", "SELECT id FROM reach", _closure(f"SELECT id FROM ({_not(f'({_not(NTL)})')}) n", True, True)),
    "deeply_immutable_obj": ("Deeply(ImmutableObj())", *_deeply(_not(MUTABLE), False)),
    "heap_deeply_immutable_obj": ("HeapDeeply(ImmutableObj())", *_deeply(_not(MUTABLE), True)),
}


def _text_query(text: str):
    return lambda spark, sf_dir: Compiler(views.tables(spark, sf_dir))(text)


def _on(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(views.tables(spark, sf_dir))


def _mutable_of(f: Callable):
    return _on(lambda t: f(t, objects.mutable(t)))


_CALLS = "caller, callee, name, callstart, callend, callsitefile, callsiteline, thread"
_APROPOS = """SELECT 'use' AS event, idx AS start, CAST(NULL AS BIGINT) AS "end", caller, callee, name, kind || ' in ' || method AS detail, thread FROM uses WHERE 136 IN (caller, callee)
  UNION ALL SELECT 'call', callstart, callend, caller, callee, name, callsitefile || ':' || callsiteline, thread FROM calls WHERE 136 IN (caller, callee)
  UNION ALL SELECT 'ref', refstart, refend, caller, callee, name, kind, thread FROM refs WHERE 136 IN (caller, callee)"""
#: name -> (function of the tables, oracle body)
TABLE: dict[str, tuple] = {
    "non_thread_local_obj": (_on(objects.non_thread_local), NTL),
    "non_stationary_obj": (_on(objects.non_stationary), NON_STATIONARY),
    "age_of_neighbours": (_on(objects.age_of_neighbours), """SELECT caller AS id, o.firstusage AS firstusage, c.firstusage AS calleefirstusage FROM (SELECT caller, callee FROM refs WHERE kind = 'field') r,
  (SELECT id, firstusage FROM objects) o, (SELECT id, firstusage FROM objects) c WHERE o.id = caller AND c.id = callee"""),
    "strictly_reverse_age_ordered_obj": (_on(objects.strictly_reverse_age_ordered), f"SELECT id FROM ({AGE}) a GROUP BY id, firstusage HAVING MIN(calleefirstusage) > firstusage"),
    "with_meta_information": (_mutable_of(stats.with_meta), f"""SELECT id, klass, allocationsitefile || ':' || allocationsiteline AS allocationsite, firstusage, lastusage, thread,
  (SELECT COUNT(*) FROM calls WHERE callee = id) AS numcalls, (SELECT COUNT(*) FROM uses WHERE callee = id AND kind = 'fieldload') AS numfieldreads,
  (SELECT COUNT(*) FROM uses WHERE callee = id AND kind = 'fieldstore') AS numfieldwrites FROM objects WHERE id IN ({MUTABLE})"""),
    "object_percentage": (_mutable_of(stats.object_percentage), f"""SELECT total, passed, {_perc('passed', 'total')} AS perc
  FROM (SELECT COUNT(*) AS total FROM objects WHERE id > 4), (SELECT COUNT(*) AS passed FROM ({MUTABLE}))"""),
    "field_aggregate": (_mutable_of(stats.field_aggregate), f"""SELECT name, total, passed, {_perc('passed', 'total')} AS perc FROM (
  SELECT klass || '::' || name AS name, COUNT(DISTINCT callee) AS total, COUNT(DISTINCT CASE WHEN callee IN ({MUTABLE}) THEN callee END) AS passed
  FROM refs JOIN objects ON id = caller WHERE kind = 'field' AND klass NOT LIKE '[%' AND callee IN (SELECT id FROM objects WHERE id >= 4) GROUP BY 1)"""),
    "field_percentage": (_on(lambda t: stats.field_aggregate(t, objects.mutable(t), 10)), f"""SELECT name, total, passed, {_perc('passed', 'total')} AS perc FROM (
  SELECT klass || '::' || name AS name, COUNT(DISTINCT callee) AS total, COUNT(DISTINCT CASE WHEN callee IN ({MUTABLE}) THEN callee END) AS passed
  FROM refs JOIN objects ON id = caller WHERE kind = 'field' AND klass NOT LIKE '[%' AND callee IN (SELECT id FROM objects WHERE id >= 4) GROUP BY 1) WHERE total >= 10"""),
    "class_percentage": (_mutable_of(stats.class_percentage), f"""SELECT klass, total, passed, {_perc('passed', 'total')} AS perc FROM (
  SELECT klass, COUNT(*) AS total, COUNT(CASE WHEN id IN ({MUTABLE}) THEN 1 END) AS passed FROM objects WHERE id > 4 GROUP BY klass) WHERE total >= 10"""),
    "apropos": (_on(lambda t: stats.apropos(t, 136)), _APROPOS),
    "apropos_json": (_on(lambda t: stats.apropos_json(t, 136)), f"SELECT start, CAST(to_json(a) AS VARCHAR) AS json FROM ({_APROPOS}) a"),
    "ctor_collapse": (_on(lambda t: loader.collapse_constructors(t["calls"]).filter(F.col("name") == "<init>")), f"""SELECT {_CALLS} FROM (SELECT caller, callee, name, MIN(callstart) OVER (PARTITION BY callee) AS callstart, callend, callsitefile, callsiteline, thread,
  ROW_NUMBER() OVER (PARTITION BY callee ORDER BY callend DESC, caller DESC, callsitefile DESC, callsiteline DESC, thread DESC) AS n FROM calls WHERE name = '<init>') WHERE n = 1"""),
    "edge_ends": (_on(lambda t: loader.field_refs(t["refs"].filter("kind = 'field'").select(F.lit("fieldstore").alias("kind"), F.col("caller").alias("callee"), F.col("callee").alias("val"), "name", F.col("refstart").alias("idx"), "thread"))),
        "SELECT caller, callee, kind, name, refstart, LEAD(refstart) OVER (PARTITION BY caller, name ORDER BY refstart) AS refend, thread FROM refs WHERE kind = 'field'"),
    "last_usages": (_on(lambda t: loader.last_usages(t["objects"], t["uses"])), """SELECT id, klass, allocationsitefile, CAST(allocationsiteline AS INT) AS allocationsiteline,
  (SELECT MIN(idx) FROM uses WHERE callee = id) AS firstusage, (SELECT MAX(idx) FROM uses WHERE callee = id) AS lastusage, thread FROM objects"""),
}


#: By definition: d dominates v if v can't be reached without d; the nearest dominator is the one with most dominators of its own.
_DOMINATORS = (
    "links AS (SELECT DISTINCT CAST(0 AS BIGINT) AS src, callee AS dst FROM refs WHERE kind = 'var' UNION SELECT 0, caller FROM refs WHERE caller < 0 UNION SELECT caller, callee FROM refs WHERE kind = 'field' AND caller <> callee)",
    "live(id) AS (SELECT CAST(0 AS BIGINT) UNION SELECT dst FROM links JOIN live ON src = id)",
    # only ids that lead on can dominate; those that the root alone refers to aren't dominated by anything else
    "cuts AS (SELECT DISTINCT src AS d FROM links JOIN live ON src = id WHERE src <> 0 AND dst NOT IN (SELECT dst FROM links WHERE src = 0))",
    "without(d, id) AS (SELECT d, CAST(0 AS BIGINT) FROM cuts UNION SELECT d, dst FROM links JOIN without ON src = id WHERE dst <> d)",
    "doms AS (SELECT d, l.id AS v FROM cuts, live l WHERE l.id NOT IN (0) AND l.id <> d AND NOT EXISTS (SELECT 1 FROM without w WHERE w.d = cuts.d AND w.id = l.id))",
)
_DOMINATORS_SQL = """SELECT id, COALESCE(ARG_MAX(doms.d, COALESCE(n, 0)), 0) AS dominator FROM live LEFT JOIN doms ON v = id LEFT JOIN (SELECT v AS d, COUNT(*) AS n FROM doms GROUP BY v) c ON c.d = doms.d WHERE id <> 0 GROUP BY id"""
TABLE["heap_dominators"] = (_on(lambda t: heap_dominators(t["refs"])), _DOMINATORS_SQL, *_DOMINATORS)

#: The primitive sets of the warm-up grid by their text.
GRID = {TEXT[k][0]: TEXT[k][1] for k in ("mutable_obj", "immutable_obj", "stationary_obj", "unique_obj", "heap_unique_obj", "tiny_obj", "stack_bound_obj", "age_ordered_obj", "reverse_age_ordered_obj", "thread_local_obj", "obj")}


def _grid(t):
    compiler = Compiler(t)
    return stats.grid_percentages(t, {text: compiler(text) for text in GRID})


_SETS = "sets AS (" + " UNION ALL ".join(f"SELECT '{text}' AS query, id FROM ({sql}) s{k}" for k, (text, sql) in enumerate(GRID.items())) + ")"
_GRID_SQL = f"""SELECT statistic, query, name, total, passed, {_perc('passed', 'total')} AS perc FROM (
  SELECT 'object' AS statistic, query, '' AS name, (SELECT COUNT(*) FROM objects WHERE id > 4) AS total, COUNT(*) AS passed FROM sets GROUP BY query
  UNION ALL SELECT 'class', q.query, klass, COUNT(*), COUNT(s.id) FROM (SELECT DISTINCT query FROM sets) q CROSS JOIN objects o LEFT JOIN sets s ON s.query = q.query AND s.id = o.id WHERE o.id > 4 GROUP BY 1, 2, 3 HAVING COUNT(*) >= 10
  UNION ALL SELECT 'field', q.query, f.name, COUNT(*), COUNT(s.id) FROM (SELECT DISTINCT query FROM sets) q CROSS JOIN (
   SELECT DISTINCT klass || '::' || name AS name, callee FROM refs JOIN objects ON id = caller WHERE kind = 'field' AND klass NOT LIKE '[%' AND callee IN (SELECT id FROM objects WHERE id >= 4)) f
   LEFT JOIN sets s ON s.query = q.query AND s.id = f.callee GROUP BY 1, 2, 3)"""
TABLE["grid_percentages"] = (_on(_grid), _GRID_SQL, _SETS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tracelens.operators import automata_catalog, loader_catalog
    from tracelens.sources import registered

    return {**{k: _text_query(v[0]) for k, v in TEXT.items()}, **{k: v[0] for k, v in TABLE.items()}, **automata_catalog.queries(), **loader_catalog.queries(), **registered.queries()}


def oracle_sql() -> dict[str, str]:
    from tracelens.operators import automata_catalog, loader_catalog
    from tracelens.sources import registered

    return {**{k: views.oracle(*v[1:]) for k, v in TEXT.items()}, **{k: views.oracle(*v[1:]) for k, v in TABLE.items() if len(v) > 1}, **automata_catalog.oracle_sql(), **loader_catalog.oracle_sql(), **registered.oracle_sql()}
