"""Statistics and look-ups over object sets. Percentages are exact: integer half-up to two places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.operators import objects
from tracelens.operators.objects import Tables


def percentage(part: Column, total: Column) -> Column:
    """round(100 * part / total, 2), half up; null if there is no total."""
    n = part * 20000 + total
    return F.when(total > 0, (n - n % (total * 2)).cast("double") / (total * 2) / 100)


def object_percentage(t: Tables, q: DataFrame) -> DataFrame:
    """One row: total, passed, perc. Passed are the distinct ids of ``q``."""
    total = t["objects"].filter("id > 4").agg(F.count("id").alias("total"))
    passed = q.select("id").distinct().agg(F.count("id").alias("passed"))
    return total.crossJoin(passed).select("total", "passed", percentage(F.col("passed"), F.col("total")).alias("perc"))  # one row each


def _flagged(q: DataFrame) -> DataFrame:
    return q.select(F.col("id").alias("_id")).distinct().withColumn("_in", F.lit(True))


def field_pairs(t: Tables) -> DataFrame:
    """Distinct (name, callee): class::field of holders that are no arrays, and a traced object that the field held."""
    holders = t["objects"].filter(~F.col("klass").startswith("[")).select(F.col("id").alias("caller"), "klass")
    held = objects.fields(t).select("caller", "callee", "name").join(holders, "caller")
    pairs = held.select(F.concat(F.coalesce("klass", F.lit("")), F.lit("::"), F.coalesce("name", F.lit(""))).alias("name"), "callee").distinct()
    return pairs.join(objects.obj(t).withColumnRenamed("id", "callee"), "callee", "left_semi")


def field_aggregate(t: Tables, q: DataFrame, min_instances: int | None = None) -> DataFrame:
    """name (class::field of non-array holders), total, passed, perc: distinct referents, and those in ``q``."""
    pairs = field_pairs(t)
    pairs = pairs.join(_flagged(q), F.col("callee") == F.col("_id"), "left")
    out = pairs.groupBy("name").agg(F.count("callee").alias("total"), F.count("_in").alias("passed"))
    out = out if min_instances is None else out.filter(F.col("total") >= min_instances)
    return out.withColumn("perc", percentage(F.col("passed"), F.col("total")))


def class_percentage(t: Tables, q: DataFrame, min_instances: int = 10) -> DataFrame:
    """klass, total, passed, perc for classes of at least ``min_instances`` objects."""
    o = t["objects"].filter("id > 4").select("id", "klass").join(_flagged(q), F.col("id") == F.col("_id"), "left")
    out = o.groupBy("klass").agg(F.count("id").alias("total"), F.count("_in").alias("passed")).filter(F.col("total") >= min_instances)
    return out.withColumn("perc", percentage(F.col("passed"), F.col("total")))


#: Sets in one word of a membership bitmap.
WORD = 60


def memberships(sets: list[DataFrame]) -> DataFrame:
    """id, m0, m1, ...: bit k of the words says whether the id is in ``sets[k]``. One shuffle of ids, with the bits of an id joined before it."""
    words = range(-(-len(sets) // WORD))
    rows = None
    for k, q in enumerate(sets):
        own = q.select("id", *[F.lit(1 << k % WORD if w == k // WORD else 0).cast("long").alias(f"m{w}") for w in words])
        rows = own if rows is None else rows.union(own)
    return rows.groupBy("id").agg(*[F.bit_or(f"m{w}").alias(f"m{w}") for w in words])


def grid_percentages(t: Tables, sets: dict[str, DataFrame], min_instances: int = 10) -> DataFrame:
    """statistic (object, class, field), query, name, total, passed, perc: what ``object_percentage``, ``class_percentage`` and
    ``field_aggregate`` say of each of the sets, from one aggregation a statistic whatever the number of sets."""
    from tracelens.plans.cutting import Scratch, cut, work_path

    spark, names = t["objects"].sparkSession, list(sets)
    counts = [F.count_if(F.col(f"m{k // WORD}").bitwiseAND(F.lit(1 << k % WORD)) != 0).alias(f"_p{k}") for k in range(len(names))]
    passed = F.explode(F.array(*[F.struct(F.lit(q).alias("query"), F.col(f"_p{k}").alias("passed")) for k, q in enumerate(names)])).alias("q")

    def flat(df: DataFrame, statistic: str, name) -> DataFrame:
        rows = df.select(name.alias("name"), "total", passed).select(F.lit(statistic).alias("statistic"), "q.query", "name", "total", "q.passed")
        return rows.withColumn("perc", percentage(F.col("passed"), F.col("total")))

    with Scratch(spark, "grid") as scratch:
        members = scratch.cut(memberships(list(sets.values())), "members")
        o = t["objects"].filter("id > 4").select("id", "klass")
        all_ = members.agg(*counts).crossJoin(o.agg(F.count("id").alias("total")))  # one row each
        classes = o.join(members, "id", "left").groupBy("klass").agg(F.count("id").alias("total"), *counts).filter(F.col("total") >= min_instances)
        fields = field_pairs(t).join(members.withColumnRenamed("id", "callee"), "callee", "left").groupBy("name").agg(F.count("callee").alias("total"), *counts)
        out = flat(all_, "object", F.lit("")).union(flat(classes, "class", F.col("klass"))).union(flat(fields, "field", F.col("name")))
        return cut(out, work_path(spark, "percentages"))


#: Kinds of the columns of ``with_meta``, for readers that plot them.
META_KINDS = {
    "allocationsite": "categorical", "klass": "categorical", "thread": "categorical", "firstusage": "numerical", "lastusage": "numerical",
    "numcalls": "numerical", "numfieldreads": "numerical", "numfieldwrites": "numerical",
}


def with_meta(t: Tables, q: DataFrame | None = None) -> DataFrame:
    """Objects of ``q`` (None: all) with their allocation site, usage span, thread and counts of calls, field reads and writes."""
    o = t["objects"] if q is None else t["objects"].join(q.select("id").distinct(), "id", "left_semi")
    calls = t["calls"].groupBy(F.col("callee").alias("id")).agg(F.count("callee").alias("numcalls"))
    read, write = F.col("kind") == "fieldload", F.col("kind") == "fieldstore"
    uses = t["uses"].filter(read | write).groupBy(F.col("callee").alias("id")).agg(F.count_if(read).alias("numfieldreads"), F.count_if(write).alias("numfieldwrites"))
    site = F.concat(F.coalesce("allocationsitefile", F.lit("")), F.lit(":"), F.coalesce(F.col("allocationsiteline").cast("string"), F.lit("")))
    none = F.lit(0).cast("long")
    return o.join(calls, "id", "left").join(uses, "id", "left").select(
        "id", "klass", site.alias("allocationsite"), "firstusage", "lastusage", "thread",
        *[F.coalesce(c, none).alias(c) for c in ("numcalls", "numfieldreads", "numfieldwrites")])


def apropos(t: Tables, id: int) -> DataFrame:
    """All uses, calls and references that touch the object: kind, start, end, caller, callee, name, detail, thread; sort by start.

    Each branch's filter is pushed to its scan. An end that is not known is null.
    """
    touches = (F.col("caller") == id) | (F.col("callee") == id)
    none = F.lit(None).cast("long")
    uses = t["uses"].filter(touches).select(F.lit("use").alias("event"), F.col("idx").alias("start"), none.alias("end"), "caller", "callee", "name", F.concat("kind", F.lit(" in "), F.coalesce("method", F.lit("?"))).alias("detail"), "thread")
    calls = t["calls"].filter(touches).select(F.lit("call").alias("event"), F.col("callstart").alias("start"), F.col("callend").alias("end"), "caller", "callee", "name",
        F.concat("callsitefile", F.lit(":"), F.col("callsiteline").cast("string")).alias("detail"), "thread")
    refs = t["refs"].filter(touches).select(F.lit("ref").alias("event"), F.col("refstart").alias("start"), F.col("refend").alias("end"), "caller", "callee", "name", F.col("kind").alias("detail"), "thread")
    return uses.unionByName(calls).unionByName(refs)


def apropos_json(t: Tables, id: int) -> DataFrame:
    """start, json: the events of ``apropos`` as JSON objects; what isn't known is null in them."""
    events = apropos(t, id)
    return events.select("start", F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("json"))


def source_code(t: Tables, klass: str) -> DataFrame:
    """The recorded bytecode of one class."""
    return t["classdumps"].filter(F.col("classname") == F.lit(klass))
