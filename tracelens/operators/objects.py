"""The primitive object sets. Each function takes the tables of a store and returns distinct ``id``s.

Bounds are part of the meaning: traced objects are those with id >= 4, negations and most sets take id > 4.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.model import JVM, READS, WRITES
from tracelens.operators.scans import CHUNK, peaks

Tables = Mapping[str, DataFrame]


def obj(t: Tables) -> DataFrame:
    return t["objects"].filter(F.col("id") >= JVM).select("id").distinct()


def universe(t: Tables) -> DataFrame:
    """What negation is taken against."""
    return t["objects"].filter(F.col("id") > JVM).select("id").distinct()


def instance_of(t: Tables, klass: str) -> DataFrame:
    return t["objects"].filter(F.col("klass") == F.lit(klass)).select("id").distinct()


def allocated_at(t: Tables, file: str, line: int) -> DataFrame:
    o = t["objects"]
    return o.filter((F.col("allocationsitefile") == F.lit(file)) & (F.col("allocationsiteline") == F.lit(line))).select("id").distinct()


def mutable(t: Tables) -> DataFrame:
    """Written to outside their own constructor. Null caller or method doesn't count as the constructor."""
    own = F.coalesce((F.col("caller") == F.col("callee")) & (F.col("method") == "<init>"), F.lit(False))
    return t["uses"].filter((F.col("callee") > JVM) & F.col("kind").isin(*WRITES) & ~own).select(F.col("callee").alias("id")).distinct()


def non_thread_local(t: Tables) -> DataFrame:
    """Used by more than one thread. min < max of the thread says so without a distinct count."""
    per = t["uses"].filter(F.col("callee") > JVM).groupBy(F.col("callee").alias("id")).agg(F.min("thread").alias("a"), F.max("thread").alias("b"))
    return per.filter("a < b").select("id")


def non_stationary(t: Tables) -> DataFrame:
    """Read and later written: the first read comes before the last write, one aggregation instead of a self join."""
    read, write = F.col("kind").isin(*READS), F.col("kind").isin(*WRITES)
    per = t["uses"].filter((F.col("callee") > JVM) & (read | write)).groupBy(F.col("callee").alias("id"))
    return per.agg(F.min(F.when(read, F.col("idx"))).alias("r"), F.max(F.when(write, F.col("idx"))).alias("w")).filter("r < w").select("id")


def max_aliases(refs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """id, most: the largest number of references that were open at once. Opening and closing at the same time net
    out, and references that are never closed close after everything else. An object with most of the references is no single task."""
    moves = refs.filter(F.col("callee") > JVM).select(F.col("callee").alias("id"), F.explode(F.array(
        F.struct(F.col("refstart").alias("time"), F.lit(1).alias("delta")), F.struct(F.col("refend").alias("time"), F.lit(-1).alias("delta")))).alias("m"))
    return peaks(moves, "id", F.col("m.time"), F.col("m.delta"), chunk).withColumnRenamed("peak", "most")


def unique(t: Tables) -> DataFrame:
    return max_aliases(t["refs"]).filter("most = 1").select("id")


def heap_unique(t: Tables) -> DataFrame:
    return max_aliases(fields(t)).filter("most = 1").select("id")


def fields(t: Tables) -> DataFrame:
    return t["refs"].filter(F.col("kind") == "field")


def stack_bound(t: Tables) -> DataFrame:
    return universe(t).join(fields(t).select(F.col("callee").alias("id")), "id", "left_anti")


def tiny(t: Tables) -> DataFrame:
    return obj(t).join(fields(t).select(F.col("caller").alias("id")), "id", "left_anti")


def age_of_neighbours(t: Tables) -> DataFrame:
    """id, firstusage, calleefirstusage: one row per field reference between known objects."""
    o = t["objects"].select("id", "firstusage")
    targets = o.select(F.col("id").alias("callee"), F.col("firstusage").alias("calleefirstusage"))
    return fields(t).select("caller", "callee").join(o, F.col("caller") == F.col("id")).join(targets, "callee").select("id", "firstusage", "calleefirstusage")


def age_ordered(t: Tables) -> DataFrame:
    per = age_of_neighbours(t).groupBy("id", "firstusage").agg(F.max("calleefirstusage").alias("latest"))
    return per.filter("latest < firstusage").select("id").distinct()


def reverse_age_ordered(t: Tables) -> DataFrame:
    per = age_of_neighbours(t).groupBy("id", "firstusage").agg(F.max("calleefirstusage").alias("latest"))
    return per.filter("latest > firstusage").select("id").distinct()


def strictly_reverse_age_ordered(t: Tables) -> DataFrame:
    """All referents are younger, which the plain form's name suggests; it asks for one only."""
    per = age_of_neighbours(t).groupBy("id", "firstusage").agg(F.min("calleefirstusage").alias("earliest"))
    return per.filter("earliest > firstusage").select("id").distinct()


BY_NAME = {
    "Obj": obj, "MutableObj": mutable, "NonThreadLocalObj": non_thread_local, "NonStationaryObj": non_stationary, "UniqueObj": unique,
    "HeapUniqueObj": heap_unique, "StackBoundObj": stack_bound, "TinyObj": tiny, "AgeOrderedObj": age_ordered, "ReverseAgeOrderedObj": reverse_age_ordered,
}
