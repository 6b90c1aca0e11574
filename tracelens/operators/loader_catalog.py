"""The loader's transforms as registered queries over a view of flat events with frames that open and close, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens import views
from tracelens.functions.text import listing
from tracelens.model import EVENT_FIELDS
from tracelens.operators import automata, loader, protocols
from tracelens.plans.cutting import work_path

#: Flat events as ``loader.flatten`` gives them, made from ``ev``: sign-ups enter a method and errors leave one, whatever is on the stack.
RAW = """SELECT idx, kind, thread, CASE WHEN kind IN ('methodenter', 'methodexit') THEN CASE WHEN k % 4 = 0 THEN '<init>' ELSE 'run' END WHEN kind IN ('varstore', 'varload') THEN NULL ELSE fname END AS name,
  CONCAT('app/C', CAST(k % 4 AS VARCHAR(10))) AS klass, CASE WHEN kind IN ('methodexit', 'varstore', 'varload') THEN NULL ELSE obj END AS callee,
  CASE WHEN kind IN ('methodenter', 'methodexit') THEN NULL ELSE usr END AS caller, CASE WHEN kind IN ('fieldstore', 'fieldload', 'varstore', 'varload') THEN event_type END AS callermethod,
  CASE WHEN kind IN ('fieldstore', 'fieldload', 'varstore', 'varload') THEN val END AS val, CASE WHEN kind IN ('varstore', 'varload') THEN CAST(k % 3 AS INT) END AS var,
  CASE WHEN kind = 'readmodify' THEN k % 2 = 0 END AS is_modify, CASE WHEN kind = 'methodenter' THEN 'App.java' END AS sitefile, CASE WHEN kind = 'methodenter' THEN k END AS siteline
 FROM (SELECT a.*, CASE WHEN a.k % 7 = 0 THEN 0 ELSE b.obj END AS val, CASE a.event_type WHEN 'signup' THEN 'methodenter' WHEN 'error' THEN 'methodexit' WHEN 'view' THEN CASE WHEN a.k % 2 = 0 THEN 'varstore' ELSE 'fieldload' END
   WHEN 'click' THEN CASE WHEN a.k % 3 = 0 THEN 'varload' ELSE 'readmodify' END ELSE 'fieldstore' END AS kind FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.rn = CAST(FLOOR(a.rn/2) AS BIGINT)) e"""

_PREFIX = "OVER (PARTITION BY thread ORDER BY idx)"
#: What the oracles share: the running depth, cut off at the empty stack; frames with their exits; events beside the frame below or around them.
STEPS = (
    f"raw AS ({RAW})",
    f"summed AS (SELECT *, CAST(SUM(CASE kind WHEN 'methodenter' THEN 1 WHEN 'methodexit' THEN -1 ELSE 0 END) {_PREFIX} AS BIGINT) AS run FROM raw WHERE kind IN ('methodenter', 'methodexit', 'varstore', 'readmodify'))",
    f"lowest AS (SELECT *, LEAST(0, MIN(run) {_PREFIX}) AS low FROM summed)",
    f"deep AS (SELECT *, run - low AS depth, kind = 'methodexit' AND low < COALESCE(LAG(low) {_PREFIX}, 0) AS underflow FROM lowest)",
    """ends AS (SELECT *, LEAD(kind) OVER w AS next_kind, LEAD(idx) OVER w AS next_idx, LEAD(name) OVER w AS next_name
 FROM (SELECT *, CASE kind WHEN 'methodenter' THEN depth ELSE depth + 1 END AS level FROM deep WHERE kind IN ('methodenter', 'methodexit') AND NOT underflow) o WINDOW w AS (PARTITION BY thread, level ORDER BY idx))""",
    "frames AS (SELECT *, CASE WHEN next_kind = 'methodexit' THEN next_idx END AS leaves, next_kind = 'methodexit' AND next_name = name AS clean FROM ends WHERE kind = 'methodenter')",
    """around AS (SELECT d.*, CASE WHEN d.depth > 0 THEN f.idx END AS frame, CASE WHEN d.depth > 0 THEN f.name END AS frame_name, CASE WHEN d.depth > 0 AND f.clean THEN f.leaves END AS frame_end
 FROM deep d ASOF LEFT JOIN frames f ON d.thread = f.thread AND d.depth = f.level AND d.idx > f.idx WHERE d.kind IN ('varstore', 'readmodify'))""",
)


#: Chunks of so many events, so that there are several at every size.
CHUNK = 1000


def _framed(flat):
    return loader.in_frames(loader.with_depth(flat.filter("kind IN ('methodenter', 'methodexit', 'varstore', 'readmodify')"), CHUNK), CHUNK)


QUERIES = {
    "load_depth": (lambda e: loader.with_depth(e.filter("kind IN ('methodenter', 'methodexit', 'varstore', 'readmodify')"), CHUNK).select("idx", "thread", "depth", "underflow"), "SELECT idx, thread, depth, underflow FROM deep"),
    "load_quarantine": (lambda e: loader.with_depth(e.filter("kind IN ('methodenter', 'methodexit', 'varstore', 'readmodify')")).filter("underflow").select("idx", "thread", "name", "klass"), "SELECT idx, thread, name, klass FROM deep WHERE underflow"),
    "load_calls": (lambda e: loader.raw_calls(_framed(e)[0]), """SELECT COALESCE(b.callee, 4) AS caller, f.callee AS callee, f.name AS name, f.idx AS callstart, f.leaves AS callend, f.sitefile AS callsitefile, f.siteline AS callsiteline, f.thread AS thread
  FROM frames f ASOF LEFT JOIN frames b ON f.thread = b.thread AND f.level - 1 = b.level AND f.idx > b.idx WHERE f.clean"""),
    "load_field_refs": (lambda e: loader.field_refs(e, chunk=CHUNK), "SELECT callee AS caller, val AS callee, 'field' AS kind, name, idx AS refstart, LEAD(idx) OVER (PARTITION BY callee, name ORDER BY idx) AS refend, thread FROM raw WHERE kind = 'fieldstore' AND val <> 0"),
    "load_var_refs": (lambda e: loader.var_refs(_framed(e)[1], CHUNK), """SELECT caller, val AS callee, 'var' AS kind, 'var_' || var AS name, idx AS refstart, CASE WHEN frame IS NOT NULL THEN COALESCE(later, frame_end) END AS refend, thread
  FROM (SELECT *, LEAD(idx) OVER (PARTITION BY thread, frame, var ORDER BY idx) AS later FROM around WHERE kind = 'varstore') s WHERE val <> 0"""),
    "load_uses": (lambda e: loader.uses(e, _framed(e)[1]), """SELECT caller, COALESCE(callee, caller) AS callee, COALESCE('var_' || var, name) AS name, callermethod AS method, kind, idx, thread FROM raw WHERE kind IN ('fieldload', 'fieldstore', 'varload', 'varstore')
  UNION ALL SELECT caller, callee, name, COALESCE(frame_name, '<unknown>'), CASE WHEN is_modify THEN 'modify' ELSE 'read' END, idx, thread FROM around WHERE kind = 'readmodify'"""),
    "load_frames": (lambda e: _framed(e)[0].select("idx", "thread", F.col("depth").alias("level"), F.col("frame.idx").alias("below"), "exit"), """SELECT f.idx AS idx, f.thread AS thread, f.level AS level, CASE WHEN f.level > 1 THEN b.idx END AS below, f.leaves AS exit
  FROM frames f ASOF LEFT JOIN frames b ON f.thread = b.thread AND f.level - 1 = b.level AND f.idx > b.idx"""),
    "check_stack": (lambda e: automata.check_stack(_framed(e)[0]), "SELECT leaves AS idx, thread, name, next_name AS exit_name FROM frames WHERE leaves IS NOT NULL AND next_name <> name"),
    "load_objects": (loader.objects, """SELECT callee AS id, REPLACE(ARG_MAX(klass, idx), '/', '.') AS klass, ARG_MIN(sitefile, idx) AS allocationsitefile, CAST(ARG_MIN(siteline, idx) AS INT) AS allocationsiteline, ARG_MIN(thread, idx) AS thread
  FROM raw WHERE kind = 'methodenter' AND name = '<init>' GROUP BY callee"""),
}

#: For protocols: the depth of all events, the two frames around each, constructed objects with their class and constructing frame.
PROTOCOL_STEPS = (
    STEPS[0], STEPS[1].replace(" WHERE kind IN ('methodenter', 'methodexit', 'varstore', 'readmodify')", ""), *STEPS[2:5],
    "entered AS (SELECT thread, depth AS level, idx, klass FROM deep WHERE kind = 'methodenter')",
    "placed AS (SELECT *, CASE WHEN kind = 'methodenter' THEN depth - 1 ELSE depth END AS level FROM deep WHERE kind IN ('methodenter', 'fieldstore', 'fieldload', 'readmodify'))",
    """two AS (SELECT p.*, CASE WHEN p.level > 0 THEN f.idx END AS top, CASE WHEN p.level > 0 THEN f.klass END AS top_klass, CASE WHEN p.level > 1 THEN g.idx END AS below
 FROM placed p ASOF LEFT JOIN entered f ON p.thread = f.thread AND p.level = f.level AND p.idx > f.idx ASOF LEFT JOIN entered g ON p.thread = g.thread AND p.level - 1 = g.level AND p.idx > g.idx)""",
    "made AS (SELECT callee AS id, MIN(idx) AS born, ARG_MIN(klass, idx) AS klass, ARG_MIN(COALESCE(top, -1), idx) AS creator FROM two WHERE kind = 'methodenter' AND name = '<init>' AND callee > 4 GROUP BY callee)",
)
_VERDICT = "SELECT m.id, MIN(e.idx) IS NULL AS ok, MIN(e.idx) AS at FROM made m LEFT JOIN two e ON e.callee = m.id AND e.idx > m.born AND {broken} GROUP BY m.id"
PROTOCOLS = {
    "class_private": "(e.kind = 'fieldstore' OR (e.kind = 'readmodify' AND e.is_modify)) AND e.top_klass IS DISTINCT FROM m.klass",
    "near_creator": "e.kind <> 'methodenter' AND NOT (m.creator = COALESCE(e.top, -1) OR COALESCE(m.creator = e.below, FALSE))",
}

#: The same events with late initialisations, threads of the runtime and fields without a name among them.
MIXED = """SELECT idx, CASE WHEN kind = 'fieldstore' AND idx % 7 = 0 THEN 'lateinit' ELSE kind END AS kind, CASE WHEN idx % 41 = 0 THEN 'Finalizer' ELSE thread END AS thread,
  CASE WHEN kind = 'fieldload' AND idx % 53 = 0 THEN '' ELSE name END AS name, klass, callee, caller, callermethod, val, var, is_modify, sitefile, siteline FROM raw0"""
LOAD_STEPS = (
    f"raw0 AS ({RAW})", f"mixed AS ({MIXED})", "raw AS (SELECT * FROM mixed WHERE thread <> 'Finalizer' AND kind <> 'lateinit')", "late AS (SELECT * FROM mixed WHERE kind = 'lateinit')", *STEPS[1:],
    "all_uses AS ({load_uses})", "all_calls AS ({load_calls})",
    "all_refs AS ({load_field_refs} UNION ALL {load_var_refs} UNION ALL SELECT callee, val, 'field', name, 1, NULL, 'late initialisation' FROM late WHERE val <> 0)",
    """born AS (SELECT callee AS id, REPLACE(klass, '/', '.') AS klass, sitefile, siteline, thread, idx FROM raw WHERE kind = 'methodenter' AND name = '<init>'
  UNION ALL SELECT callee, REPLACE(klass, '/', '.'), '<jvm internals>', -1, 'late initialisation', idx FROM late)""",
    """inits AS (SELECT *, MIN(callstart) OVER (PARTITION BY callee) AS first, ROW_NUMBER() OVER (PARTITION BY callee ORDER BY callend DESC) AS n FROM all_calls WHERE name = '<init>')""",
)
LOAD_SQL = """SELECT 'uses' AS place, idx AS start, CAST(NULL AS BIGINT) AS "end", caller, callee, name, kind || ' in ' || method AS detail, thread FROM all_uses
 UNION ALL SELECT 'refs', refstart, refend, caller, callee, name, kind, thread FROM all_refs
 UNION ALL SELECT 'calls', callstart, callend, caller, callee, name, callsitefile || ':' || callsiteline, thread FROM all_calls WHERE name <> '<init>'
 UNION ALL SELECT 'calls', first, callend, caller, callee, name, callsitefile || ':' || callsiteline, thread FROM inits WHERE n = 1
 UNION ALL SELECT 'objects', u.a, u.b, NULL, o.id, o.klass, o.site, o.thread FROM (SELECT id, ARG_MAX(klass, idx) AS klass, ARG_MIN(sitefile, idx) || ':' || ARG_MIN(siteline, idx) AS site, ARG_MIN(thread, idx) AS thread FROM born GROUP BY id) o
  LEFT JOIN (SELECT callee, MIN(idx) AS a, MAX(idx) AS b FROM all_uses GROUP BY callee) u ON u.callee = o.id
 UNION ALL SELECT 'quarantine', idx, NULL, NULL, NULL, name, klass, thread FROM deep WHERE underflow
 UNION ALL SELECT 'rejected uses', idx, NULL, caller, callee, name, 'empty name', thread FROM all_uses WHERE name = ''"""

#: What a line of text says of an event, and queries over the trace as it comes, before any thread is left out.
_TEXT = """CONCAT('#', idx, ': ', CASE kind
  WHEN 'methodenter' THEN CONCAT('==>  (', klass, ' @ ', callee, ') . ', name, ' , callsite=', sitefile, ':', siteline, ' , thread=', thread) WHEN 'methodexit' THEN CONCAT('<== (??? @ ', klass, ') . ', name, '(???), thread=', thread)
  WHEN 'fieldstore' THEN CONCAT('fieldStore - caller= :: ', callermethod, ' @ ', caller, ' , holder=', klass, ' @ ', callee, ' , field= ', name, ' , value= was  , is ', val, ' , thread=', thread)
  WHEN 'fieldload' THEN CONCAT('fieldLoad - caller= :: ', callermethod, ' @ ', caller, ' , holder=', klass, ' @ ', callee, ' , field= ', name, ' , thread=', thread)
  WHEN 'varstore' THEN CONCAT('varstore - caller= :: ', callermethod, ' @ ', caller, ' var ', var, ' , value was  , now is ', val, ' , thread=', thread) WHEN 'varload' THEN CONCAT('varload - caller= @ ', caller, ' , var ', var, ' , val=', val, ' , thread=', thread)
  WHEN 'readmodify' THEN CONCAT('readmodify - callee=', klass, ' @ ', callee, ' , caller= @ ', caller, CASE WHEN is_modify THEN ' writes ' ELSE ' reads ' END, name)
  WHEN 'lateinit' THEN CONCAT('lateInitialisation - callee=', klass, ' @ ', callee, ' [ ', name, ' = ', val, ' ]') END)"""
TRACE_QUERIES = {
    "event_lines": (listing, f"SELECT idx, {_TEXT} AS line FROM mixed"),
    "traced_lines": (automata.traced, f"SELECT idx, {_TEXT} AS line FROM mixed WHERE kind = 'lateinit' OR (thread NOT LIKE '%JVM_Thread<%' AND thread <> 'DestroyJavaVM')"),
    "load_relevant": (lambda e: loader.relevant(loader.flatten(e)).select("idx", "kind", "thread"), "SELECT idx, kind, thread FROM mixed WHERE thread <> 'Finalizer' AND kind <> 'lateinit'"),
}


def trace(spark, sf_dir):
    return nested(spark.sql(MIXED.replace("FROM raw0", "FROM {raw0}"), raw0=flat(spark, sf_dir)))


def nested(flat: DataFrame) -> DataFrame:
    """Flat events as a trace has them: one filled struct a row."""
    of = {"calleeclass": "klass", "cname": "klass", "holderclass": "klass", "calleetag": "callee", "holdertag": "callee", "newval": "val", "fname": "name", "callertag": "caller", "threadName": "thread",
        "callsitefile": "sitefile", "callsiteline": "siteline", "isModify": "is_modify"}
    one_field = F.array(F.struct(F.col("name").alias("name"), F.col("val").alias("val")))

    def struct(kind: str):
        fields = [one_field if f.name == "fields" else F.col(of.get(f.name, f.name)) if of.get(f.name, f.name) in flat.columns else F.lit(None) for f in EVENT_FIELDS[kind].fields]
        return F.when(F.col("kind") == kind, F.struct(*[c.cast(f.dataType).alias(f.name) for c, f in zip(fields, EVENT_FIELDS[kind].fields)])).alias(kind)

    return flat.select("idx", "kind", *[struct(k) for k in EVENT_FIELDS])


def loaded(spark, sf_dir):
    """All tables of a store that a trace was loaded into, one under the other, with its quarantine and rejected rows."""
    from tracelens.sources.store import Store

    store = Store(spark, work_path(spark, "loaded")).load(trace(spark, sf_dir), include_late_init=True, chunk=CHUNK)
    t = store.tables() | {name: spark.read.parquet(f"{store.folder}/{name}") for name in ("quarantine", "rejected")}
    none, site = F.lit(None).cast("long"), lambda a, b: F.concat(F.col(a), F.lit(":"), F.col(b).cast("string"))
    row = lambda df, place, start, end, caller, callee, name, detail, thread="thread": df.select(
        F.lit(place).alias("place"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in zip(("start", "end", "caller", "callee", "name", "detail", "thread"), (start, end, caller, callee, name, detail, thread))])
    broken, json = t["rejected"], lambda f: F.get_json_object("row", f"$.{f}")
    parts = [
        row(t["uses"], "uses", "idx", none, "caller", "callee", "name", F.concat("kind", F.lit(" in "), "method")), row(t["refs"], "refs", "refstart", "refend", "caller", "callee", "name", "kind"),
        row(t["calls"], "calls", "callstart", "callend", "caller", "callee", "name", site("callsitefile", "callsiteline")),
        row(t["objects"], "objects", "firstusage", "lastusage", none, "id", "klass", site("allocationsitefile", "allocationsiteline")), row(t["quarantine"], "quarantine", "idx", none, none, none, "name", "klass"),
        row(broken.withColumn("thread", json("thread")), "rejected uses", json("idx").cast("long"), none, json("caller").cast("long"), json("callee").cast("long"), json("name"), "why"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flat(spark, sf_dir):
    return spark.sql(RAW.replace("FROM ev a JOIN ev b", "FROM {ev} a JOIN {ev} b"), ev=views.tables(spark, sf_dir)["ev"])


def queries():
    out = {k: (lambda spark, sf_dir, f=v[0]: f(flat(spark, sf_dir))) for k, v in QUERIES.items()}
    out |= {k: (lambda spark, sf_dir, f=v[0]: f(trace(spark, sf_dir))) for k, v in TRACE_QUERIES.items()}
    return out | {"load_tables": loaded} | {f"protocol_{k}": (lambda spark, sf_dir, p=protocols.REGISTERED[k]: protocols.verdicts(flat(spark, sf_dir), p, CHUNK)) for k in PROTOCOLS}


def oracle_sql() -> dict[str, str]:
    out = {k: f"WITH ev AS ({views.EV}), {', '.join(STEPS)} {v[1]}" for k, v in QUERIES.items()}
    bodies = {k: v[1] for k, v in QUERIES.items()}
    steps = ", ".join(x.format(**bodies) if "{load_" in x else x for x in LOAD_STEPS)
    out |= {k: f"WITH ev AS ({views.EV}), {', '.join(LOAD_STEPS[:2])} {v[1]}" for k, v in TRACE_QUERIES.items()}
    return out | {"load_tables": f"WITH ev AS ({views.EV}), {steps} {LOAD_SQL}"} | {f"protocol_{k}": f"WITH ev AS ({views.EV}), {', '.join(PROTOCOL_STEPS)} {_VERDICT.format(broken=v)}" for k, v in PROTOCOLS.items()}
