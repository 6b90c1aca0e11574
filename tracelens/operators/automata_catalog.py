"""Registered automata over the flat-event view, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens import views
from tracelens.operators import automata as A

#: Flat events made from ``ev``: a user's n-th event gives out its n/2-th object.
FLAT = """SELECT idx, kind, thread, name, klass, callee, caller, callermethod, val,
  CASE WHEN kind = 'fieldstore' THEN COALESCE(LAG(val) OVER (PARTITION BY callee, name, kind ORDER BY idx), 0) END AS oldval, var, is_modify
 FROM (SELECT a.idx AS idx, CASE WHEN a.event_type = 'view' AND a.k % 2 = 0 THEN 'varstore' WHEN a.event_type = 'view' THEN 'fieldload' WHEN a.event_type = 'click' AND a.k % 3 = 0 THEN 'varload'
   WHEN a.event_type IN ('click', 'error') THEN 'readmodify' WHEN a.event_type = 'signup' THEN 'methodenter' ELSE 'fieldstore' END AS kind,
  a.thread AS thread, CASE WHEN a.event_type = 'signup' THEN '<init>' ELSE a.fname END AS name, CONCAT('app.C', CAST(a.k % 4 AS VARCHAR(10))) AS klass, a.obj AS callee, a.usr AS caller,
  a.event_type AS callermethod, b.obj AS val, CAST(a.k % 3 AS INT) AS var, a.event_type = 'error' AS is_modify
  FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.rn = CAST(FLOOR(a.rn/2) AS BIGINT)) e"""


def flat(spark, sf_dir):
    sql = FLAT.replace("FROM ev a JOIN ev b", "FROM {ev} a JOIN {ev} b")
    return spark.sql(sql, ev=views.tables(spark, sf_dir)["ev"])


_MODIFY = "(kind = 'fieldstore' OR (kind = 'readmodify' AND is_modify))"
_READ = "(kind = 'fieldload' OR (kind = 'readmodify' AND NOT is_modify))"
_BORN = "SELECT callee AS id, MIN(idx) AS born FROM flat WHERE kind = 'methodenter' AND name = '<init>' AND callee > 4 GROUP BY callee"
_MOVED = "kind IN ('fieldstore', 'fieldload', 'varstore', 'varload') AND val > 4"


def _asked(failed: str) -> str:
    return f"SELECT id, id NOT IN ({failed}) AS ok FROM ({_BORN})"


def _elsewhere(kinds: str, slot: str) -> str:
    return f"""SELECT id, idx FROM (SELECT id, idx, store, place, LAST_VALUE(CASE WHEN store THEN place END IGNORE NULLS) OVER (PARTITION BY id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
  FROM (SELECT val AS id, idx, kind LIKE '%store' AS store, CASE WHEN kind LIKE 'field%' THEN 'f:' || callee || ':' || name ELSE {slot} END AS place FROM flat WHERE kind IN ({kinds}) AND val > 4)) WHERE NOT store AND newest <> place"""


_ALL_KINDS, _FIELD_KINDS = "'fieldstore', 'fieldload', 'varstore', 'varload'", "'fieldstore', 'fieldload'"
_SLOT = "'v:' || caller || ':' || var"
_STATIONARY = f"SELECT r.callee FROM flat r JOIN flat w ON r.callee = w.callee AND r.idx < w.idx WHERE {_READ.replace('kind', 'r.kind').replace('is_modify', 'r.is_modify')} AND {_MODIFY.replace('kind', 'w.kind').replace('is_modify', 'w.is_modify')}"
_IMMUTABLE = f"SELECT p.id FROM (SELECT val AS id, MIN(idx) AS o FROM flat WHERE {_MOVED} GROUP BY val) p JOIN (SELECT callee AS id, MAX(idx) AS l FROM flat WHERE {_MODIFY} GROUP BY callee) w ON p.id = w.id WHERE l > o"
_LOCAL = f"SELECT id FROM (SELECT callee AS id, thread FROM flat WHERE callee > 4 UNION ALL SELECT val, thread FROM flat WHERE {_MOVED}) GROUP BY id HAVING COUNT(DISTINCT thread) > 1"
_TYPES = "SELECT callee AS id, ARG_MIN(klass, idx) AS klass FROM flat WHERE kind = 'methodenter' GROUP BY callee"
_DEGREE = """SELECT id, MAX(open) <= 1 AS ok FROM (SELECT id, SUM(d) OVER (PARTITION BY id ORDER BY idx) AS open FROM (
  SELECT val AS id, idx, 1 AS d FROM flat WHERE kind = 'fieldstore' AND val > 4 UNION ALL SELECT oldval, idx, -1 FROM flat WHERE kind = 'fieldstore' AND oldval > 4)) GROUP BY id"""


def _as_text(df, column):
    """Arrays as text, which both engines write alike."""
    return df.withColumn(column, F.concat_ws(",", F.transform(column, lambda v: v.cast("string"))))


#: Chunks of so many events, so that there are several at every size.
CHUNK = 1000


def _observed(f):
    """The stationary protocol once more, by the general fold: (first read, last write) of a stretch, and whether a write follows a read."""
    e = f.filter(f"{A._MODIFY} or {A._READ}").select("idx", "callee", F.expr(A._READ).alias("is_read"))

    def summarise(x):
        reads, writes = x["idx"][x["is_read"]], x["idx"][~x["is_read"]]
        return bool(len(reads)), bool(len(writes)), bool(len(reads) and len(writes) and writes[-1] > reads[0])

    combine = lambda a, b: (a[0] or b[0], a[1] or b[1], a[2] or b[2] or (a[0] and b[1]))
    return A.observe(e, "callee", ["idx", "is_read"], "has_read boolean, has_write boolean, broken boolean", summarise, combine, lambda s: not s[2], CHUNK)


QUERIES = {
    "count_kinds": (A.count_kinds, """SELECT CASE WHEN kind = 'readmodify' THEN CASE WHEN is_modify THEN 'modify' ELSE 'read' END ELSE kind END AS kind, COUNT(*) AS n FROM flat GROUP BY 1
  UNION ALL SELECT 'total', COUNT(*) FROM flat"""),
    "kind_bars": (A.kind_bars, """SELECT kind, n, REPEAT('#', CAST(FLOOR(n / POW(10.0, CEIL(LOG10(CAST(n AS DOUBLE)))) * 70) AS INT)) AS bar FROM (SELECT CASE WHEN kind = 'readmodify' THEN CASE WHEN is_modify THEN 'modify' ELSE 'read' END ELSE kind END AS kind, COUNT(*) AS n FROM flat GROUP BY 1
  UNION ALL SELECT 'total', COUNT(*) FROM flat)"""),
    "guarded_types": (lambda f: A.guarded(f, F.col("thread") != "worker-0", A.log_types), "SELECT callee AS id, ARG_MIN(klass, idx) AS klass FROM flat WHERE kind = 'methodenter' AND thread <> 'worker-0' GROUP BY callee"),
    "succeed": (lambda f: A.succeed(f).select("idx", "accepting"), "SELECT idx, TRUE AS accepting FROM flat"),
    "log_var_refs": (lambda f: _as_text(A.log_var_refs(f), "vals"), "SELECT caller AS id, callermethod || '::' || var AS var, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT val)), ',') AS vals FROM flat WHERE kind = 'varstore' GROUP BY 1, 2"),
    "log_field_refs": (lambda f: _as_text(A.log_field_refs(f), "vals"), """SELECT id, field, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT val)), ',') AS vals FROM (SELECT callee AS id, name AS field, val FROM flat WHERE kind = 'fieldstore'
  UNION ALL SELECT below, '<ALLOCATED_OBJS>', callee FROM (SELECT callee, name, LAG(callee) OVER (PARTITION BY thread ORDER BY idx) AS below  -- no frame of the view ends
    FROM flat WHERE kind = 'methodenter') WHERE name = '<init>' AND below IS NOT NULL) GROUP BY 1, 2"""),
    "log_types": (A.log_types, _TYPES),
    "lifetimes": (A.lifetimes, "SELECT callee AS id, MIN(idx) AS first, MAX(idx) AS last FROM flat WHERE callee > 4 GROUP BY callee"),
    "ignore_background": (lambda f: A.ignore_background(f).groupBy("thread").agg(F.count("*").alias("n")), "SELECT thread, COUNT(*) AS n FROM flat WHERE thread NOT LIKE '%JVM_Thread<%' AND thread <> 'DestroyJavaVM' GROUP BY thread"),
    "events_counted": (A.counted, "SELECT COUNT(*) AS events, MAX(idx) AS last_idx FROM flat"),
    "forever_not_modified": (lambda f: A.forever(f, ~F.expr(A._MODIFY), chunk=CHUNK), f"SELECT idx, callee AS key, MIN(CASE WHEN {_MODIFY} THEN 0 ELSE 1 END) OVER (PARTITION BY callee ORDER BY idx) = 1 AS accepting FROM flat"),
    "observe_stationary": (_observed, f"SELECT DISTINCT callee AS key, callee NOT IN ({_STATIONARY}) AS accepting FROM flat WHERE {_MODIFY} OR {_READ}"),
    "two_counts": (lambda f: A.two(A.counted(f), A.counted(f.filter("kind = 'fieldstore'"))), "SELECT '1' AS label, COUNT(*) AS events, MAX(idx) AS last_idx FROM flat UNION ALL SELECT '2', COUNT(*), MAX(idx) FROM flat WHERE kind = 'fieldstore'"),
    "partition_by_thread": (lambda f: A.partitioned(f, F.col("thread"), lambda e, k: e.groupBy(k, "kind").agg(F.count("*").alias("n"))), "SELECT thread AS key, kind, COUNT(*) AS n FROM flat GROUP BY 1, 2"),
    "reference_graph": (A.reference_graph, """SELECT src, dst, label, CAST(SUM(d) AS BIGINT) AS n FROM (SELECT callee AS src, val AS dst, name AS label, 1 AS d FROM flat WHERE kind = 'fieldstore'
  UNION ALL SELECT callee, oldval, name, -1 FROM flat WHERE kind = 'fieldstore') WHERE dst <> 0 GROUP BY 1, 2, 3 HAVING SUM(d) <> 0"""),
    "max_in_degree": (lambda f: A.max_in_degree(f, 1, CHUNK), _DEGREE),
    "proto_any": (A.any_object, _asked("SELECT -99")),
    "proto_immutable": (A.immutable, _asked(_IMMUTABLE)),
    "proto_thread_local": (A.thread_local, _asked(_LOCAL)),
    "proto_stationary": (A.stationary, _asked(_STATIONARY)),
    "proto_unique": (A.unique, _asked(f"SELECT id FROM ({_elsewhere(_ALL_KINDS, _SLOT)})")),
    "proto_heap_moves": (A.heap_moves, _asked(f"SELECT id FROM ({_elsewhere(_FIELD_KINDS, _SLOT)})")),
    "proto_moves": (A.moves, _asked("SELECT id FROM (" + _elsewhere(_ALL_KINDS, "'v'") + ")")),
    "proto_check": (A.lifecycle_violations, f"SELECT callee AS id, idx, 'before construction' AS why FROM flat JOIN ({_BORN}) ON id = callee WHERE idx < born UNION ALL SELECT id, idx, 'not the owner' FROM ({_elsewhere(_ALL_KINDS, _SLOT)})"),
    "proto_debug": (lambda f: A.debugged(f, 136).select("idx", "kind", "callee", "caller", "val"), "SELECT idx, kind, callee, caller, val FROM flat WHERE callee = 136 OR caller = 136 OR val = 136"),
    "per_class_stats": (lambda f: A.per_class_stats(f, "heap_moves"), f"""SELECT klass, CAST(SUM(CASE WHEN ok THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS prop, CAST(SUM(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS succ, CAST(SUM(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS fail
  FROM ({_asked(f'SELECT id FROM ({_elsewhere(_FIELD_KINDS, _SLOT)})')}) JOIN ({_TYPES}) USING (id) GROUP BY klass"""),
    "per_object_stats": (lambda f: A.per_object_stats(f, "immutable"), f"SELECT id, CASE WHEN ok THEN 'survived' ELSE 'failed' END AS status FROM ({_asked(_IMMUTABLE)})"),
    "per_object_query": (lambda f: A.per_object_query(f, "stationary"), f"""SELECT alive, dead, callees, callees - alive - dead AS ignored FROM (SELECT CAST(SUM(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS alive, CAST(SUM(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS dead FROM ({_asked(_STATIONARY)})),
  (SELECT COUNT(DISTINCT callee) AS callees FROM flat)"""),
    "one_per_object": (lambda f: A.one_per_object(A.max_in_degree(f, 1)), f"""SELECT objects, accepting, CAST((20000 * accepting + objects) - (20000 * accepting + objects) % (2 * objects) AS DOUBLE) / (2 * objects) / 100 AS perc
  FROM (SELECT COUNT(*) AS objects, COUNT(CASE WHEN ok THEN 1 END) AS accepting FROM ({_DEGREE}))"""),
}


def queries():
    return {k: (lambda spark, sf_dir, f=v[0]: f(flat(spark, sf_dir))) for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: views.oracle(v[1], f"flat AS ({FLAT})") for k, v in QUERIES.items()}
