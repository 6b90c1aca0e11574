"""Query trees to DataFrames over a store."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.operators import objects
from tracelens.plans.ast import AllocatedAt, And, Connected, Ids, InstanceOf, Not, Or, Primitive, Query, digest, simplified
from tracelens.plans.cutting import cut, work_path
from tracelens.plans.fixpoint import reach
from tracelens.plans.parser import parse


def edges(tables: Mapping[str, DataFrame], heap: bool, backwards: bool) -> DataFrame:
    """Distinct (src, dst) along references."""
    refs = objects.fields(tables) if heap else tables["refs"]
    src, dst = ("callee", "caller") if backwards else ("caller", "callee")
    return refs.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()


class Compiler:
    """Compiles queries over one set of tables; equal sub-queries are compiled once, and closures are computed
    once and kept in the shared folder. ``cache`` (see ``sources.cache``) keeps results across sessions."""

    def __init__(self, tables: Mapping[str, DataFrame], cache=None):
        self.tables, self.cache, self.memo, self.known_edges = tables, cache, {}, {}

    def __call__(self, q: Query | str) -> DataFrame:
        q = simplified(parse(q) if isinstance(q, str) else q)
        key = digest(q)
        if key not in self.memo:
            held = self.cache.get(key) if self.cache else None
            self.memo[key] = self.compiled(q) if held is None else held
        return self.memo[key]

    def edges(self, heap: bool, backwards: bool) -> DataFrame:
        """Used in every round of every closure, so distinct edges are written once."""
        if (heap, backwards) not in self.known_edges:
            found = edges(self.tables, heap, backwards)
            self.known_edges[heap, backwards] = cut(found, work_path(found.sparkSession, "edges"))
        return self.known_edges[heap, backwards]

    def compiled(self, q: Query) -> DataFrame:
        t = self.tables
        if isinstance(q, Primitive):
            return objects.BY_NAME[q.name](t)
        if isinstance(q, InstanceOf):
            return objects.instance_of(t, q.klass)
        if isinstance(q, AllocatedAt):
            return objects.allocated_at(t, q.file, q.line)
        if isinstance(q, Ids):
            spark = t["objects"].sparkSession
            return spark.createDataFrame([(v,) for v in q.values], "id long")
        if isinstance(q, Not):
            return objects.universe(t).join(self(q.inner), "id", "left_anti")
        if isinstance(q, Or):
            first, *rest = map(self, q.parts)
            for p in rest:
                first = first.union(p)
            return first.distinct()
        if isinstance(q, And):
            return self.intersection(q)
        if isinstance(q, Connected):
            return self.connected(q)
        raise TypeError(f"cannot compile {q!r}")

    def intersection(self, q: And) -> DataFrame:
        """Semi joins, starting from a positive part; ``Not`` parts next to it become anti joins on its rows alone."""
        parts = sorted(q.parts, key=lambda p: isinstance(p, Not))
        first, *rest = parts
        out = self(first)
        for p in rest:
            if isinstance(p, Not):
                out = out.filter(F.col("id") > 4).join(self(p.inner), "id", "left_anti")
                out = out.join(objects.universe(self.tables), "id", "left_semi")
            else:
                out = out.join(self(p), "id", "left_semi")
        return out

    def connected(self, q: Connected) -> DataFrame:
        heap, inner = "Heap" in q.how, self(q.inner)
        if "Reach" in q.how:
            return reach(self.edges(heap, backwards=q.how.startswith("Can")), inner)
        refs = objects.fields(self.tables) if heap else self.tables["refs"]
        at, to = ("callee", "caller") if "RefersTo" in q.how else ("caller", "callee")
        return refs.join(inner.withColumnRenamed("id", at), at, "left_semi").select(F.col(to).alias("id")).distinct()
