"""Trace-shaped views of the star-schema test tables, in DataFrame form and as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EV = """SELECT CAST(event_id + 1 AS BIGINT) AS idx, event_type, user_id, k,
  CAST(10*(user_id*100 + k + 1) + 6 AS BIGINT) AS obj, CAST(10*(user_id + 1) + 7 AS BIGINT) AS usr,
  CONCAT('f', CAST(k % 5 AS VARCHAR(10))) AS fname, CONCAT('worker-', CAST(event_id % 3 AS VARCHAR(10))) AS thread,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
 FROM (SELECT event_id, event_type, user_id, CAST(REPLACE(REPLACE(props,'{"k": ',''),'}','') AS BIGINT) AS k FROM events) p"""
USES = """SELECT CASE WHEN event_type='signup' THEN obj ELSE usr END AS caller, obj AS callee, fname AS name,
 CASE WHEN event_type='signup' THEN '<init>' ELSE event_type END AS method,
 CASE event_type WHEN 'view' THEN 'fieldload' WHEN 'click' THEN 'read' WHEN 'error' THEN 'modify' ELSE 'fieldstore' END AS kind, idx, thread FROM ev"""
REFS = """SELECT caller, callee, kind, name, refstart,
 CASE WHEN kind='field' THEN LEAD(refstart) OVER (PARTITION BY caller, kind, name ORDER BY refstart)
      WHEN refstart % 4 <> 0 THEN refstart + 10 END AS refend, thread
 FROM (SELECT a.obj AS caller, b.obj AS callee, CASE WHEN a.event_type IN ('view','click') THEN 'var' ELSE 'field' END AS kind, a.fname AS name, a.idx AS refstart, a.thread
   FROM ev a JOIN ev b ON a.user_id=b.user_id AND b.rn = CAST(FLOOR(a.rn/2) AS BIGINT)) r"""
OBJECTS = """SELECT obj AS id, CASE WHEN k % 10 = 0 THEN '[I' WHEN k % 4 = 0 THEN 'app.Order' WHEN k % 4 = 1 THEN 'app.Cart' WHEN k % 4 = 2 THEN 'app.Item' ELSE 'app.Session' END AS klass,
  'App.java' AS allocationsitefile, k AS allocationsiteline, MIN(idx) AS firstusage, MAX(idx) AS lastusage, CONCAT('worker-', CAST((MIN(idx)-1) % 3 AS VARCHAR(10))) AS thread FROM ev GROUP BY obj, k
 UNION ALL SELECT usr, 'app.User', 'User.java', CAST(1 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'main' FROM (SELECT DISTINCT usr FROM ev) u
 UNION ALL SELECT CAST(-(r_regionkey+1) AS BIGINT), 'app.Static', '<jvm internals>', CAST(-1 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'main' FROM region
 UNION ALL SELECT CAST(4 AS BIGINT), 'JVM_Internals', '<jvm internals>', CAST(-1 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'main'"""
CALLS = """SELECT usr AS caller, obj AS callee, CASE WHEN event_type='signup' THEN '<init>' ELSE event_type END AS name, idx AS callstart, idx + 1 + k % 9 AS callend, 'App.java' AS callsitefile, k AS callsiteline, thread FROM ev"""

VIEWS = {"ev": EV, "uses": USES, "refs": REFS, "objects": OBJECTS, "calls": CALLS}


class Views(Mapping):
    """The store tables, and the underlying ``ev``. A table is built when it is first asked for, so a query plans those that it reads."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.built = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.built:
            self.built[name] = self.build(name)
        return self.built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(VIEWS)

    def __len__(self) -> int:
        return len(VIEWS)

    def build(self, name: str) -> DataFrame:
        if name == "ev":
            raw = self.spark.read.parquet(f"{self.sf_dir}/events.parquet")
            return self.spark.sql(EV.replace("FROM events", "FROM {events}").replace('{"k": ', '{{"k": ').replace("'}'", "'}}'"), events=raw)
        sql = VIEWS[name].replace("FROM ev a JOIN ev b", "FROM {ev} a JOIN {ev} b").replace("FROM ev", "FROM {ev}")
        if name != "objects":
            return self.spark.sql(sql, ev=self["ev"])
        region = self.spark.read.parquet(f"{self.sf_dir}/region.parquet")
        out = self.spark.sql(sql.replace("FROM region", "FROM {region}"), ev=self["ev"], region=region)
        return out.withColumn("allocationsiteline", F.col("allocationsiteline").cast("int"))


def tables(spark: SparkSession, sf_dir: str) -> Views:
    return Views(spark, sf_dir)


def oracle(body: str, *extra: str) -> str:
    """SQL with the views in front; ``extra`` are further named sub-queries ("name AS (...)")."""
    recursive = "RECURSIVE " if any("UNION SELECT" in x for x in extra) else ""
    return f"WITH {recursive}" + ",\n".join([*(f"{n} AS ({s})" for n, s in VIEWS.items()), *extra]) + "\n" + body
