"""Registered queries that write a store of the trace-shaped views and read it back, with their oracles."""

from __future__ import annotations

from tracelens import views
from tracelens.model import TABLES
from tracelens.plans.cutting import work_path
from tracelens.sources.store import Store, catalogue

#: The time that calls are looked up at.
AT = 500


def stored(spark, sf_dir: str, root: str | None = None) -> Store:
    tables = {k: v for k, v in views.tables(spark, sf_dir).items() if k in TABLES}
    return Store(spark, f"{root or work_path(spark, 'stores')}/run").write(tables, "made of views")


def _catalogue(spark, sf_dir):
    root = work_path(spark, "stores")
    stored(spark, sf_dir, root)
    return catalogue(spark, root).select("name", "objects", "comment")


QUERIES = {
    "store_uses": (lambda s, d: stored(s, d).table("uses"), "SELECT caller, callee, name, method, kind, idx, thread FROM uses"),
    "store_sql": (lambda s, d: stored(s, d).sql("SELECT klass, kind, count(*) AS n FROM refs JOIN objects ON id = callee GROUP BY klass, kind"), "SELECT klass, kind, COUNT(*) AS n FROM refs JOIN objects ON id = callee GROUP BY 1, 2"),
    "store_catalogue": (_catalogue, "SELECT 'run' AS name, COUNT(id) AS objects, 'made of views' AS comment FROM objects"),
    "store_query": (lambda s, d: stored(s, d).query("And(MutableObj() Not(UniqueObj()))"), None),
    "calls_open_at": (lambda s, d: stored(s, d).calls_at(AT), f"SELECT caller, callee, name, callstart, callend, callsitefile, callsiteline, thread FROM calls WHERE callstart <= {AT} AND callend >= {AT}"),
}


def queries():
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from tracelens import catalog

    not_unique = f"SELECT id FROM ({catalog.MUTABLE}) m WHERE id NOT IN ({catalog.TEXT['unique_obj'][1]}) AND id IN (SELECT id FROM objects WHERE id > 4)"
    return {k: views.oracle(not_unique if k == "store_query" else v[1]) for k, v in QUERIES.items()}
