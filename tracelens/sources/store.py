"""A store: one folder of typed Parquet tables per traced run, its metadata, its catalogue, its cached results."""

from __future__ import annotations

import datetime
import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.model import META, TABLES
from tracelens.operators import loader, stats
from tracelens.plans.ast import Not, Query, digest, series_of_queries
from tracelens.plans.compiler import Compiler
from tracelens.plans.cutting import cut, delete, work_path
from tracelens.plans.parser import parse
from tracelens.sources.trace import located

#: Of what a store holds; a store of another version is loaded anew.
VERSION = "3"
#: Cells that the trace is cut into for calls of each order of length, at most, and calls for each cell, at least.
CELLS, PER_CELL = 256, 100_000


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class ResultCache:
    """Results by digest under a store; object sets and statistics are apart so that either can be cleared alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def get(self, key: str, kind: str = "sets") -> DataFrame | None:
        fs, at = _fs(self.spark, f"{self.folder}/{kind}/{key}/_SUCCESS")
        return self.spark.read.parquet(f"{self.folder}/{kind}/{key}") if fs.exists(at) else None

    def put(self, key: str, df: DataFrame, kind: str = "sets") -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{kind}/{key}")
        return self.spark.read.parquet(f"{self.folder}/{kind}/{key}")

    def clear(self, only_statistics: bool = False) -> None:
        for kind in ("statistics",) if only_statistics else ("statistics", "sets"):
            fs, at = _fs(self.spark, f"{self.folder}/{kind}")
            fs.delete(at, True)


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.cache = ResultCache(spark, f"{self.folder}/cache")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}")

    def tables(self) -> dict[str, DataFrame]:
        return {k: self.table(k) for k in TABLES}

    def register(self) -> None:
        """Temp views of the tables, for plain SQL."""
        for k, df in self.tables().items():
            df.createOrReplaceTempView(k)

    def sql(self, query: str) -> DataFrame:
        """Any SQL over the tables. A failure names the query."""
        self.register()
        try:
            return self.spark.sql(query)
        except Exception as e:
            raise ValueError(f"failed query:\n{query}") from e

    def write(self, tables: dict[str, DataFrame], comment: str = "", event_count: int | None = None, **more: str) -> Store:
        """Replaces the store. Uses are range-partitioned and sorted by callee, references by caller, so
        that look-ups and ranges of ids skip row groups; calls lie in a second order for look-ups by time (``calls_at``)."""
        self.cache.clear()  # its results are of the tables that are replaced now
        delete(self.spark, f"{self.folder}/meta")  # without it the store isn't one until all tables are there
        sort = {"uses": "callee", "refs": "caller", "objects": "id", "calls": "callee"}
        for name, schema in TABLES.items():
            if name == "meta":
                continue
            df = tables.get(name)
            if df is None:
                df = self.spark.createDataFrame([], schema)
            elif name in sort:
                df = df.repartitionByRange(sort[name]).sortWithinPartitions(sort[name])
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        width = self._write_by_time()
        meta = {"comment": comment, "date": datetime.date.today().isoformat(), "version": VERSION, "cellwidth": str(width), **more}
        if event_count is not None:
            meta["eventcount"] = str(event_count)
        self.spark.createDataFrame(list(meta.items()), META).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/meta")
        return self

    def _write_by_time(self) -> int:
        """Calls by order of length, and by where they start in cells of at least that length: a call that is open at some time starts in one
        of two cells of its order. Returns the least width of a cell."""
        calls = self.table("calls").filter("callend >= callstart")
        last, n = calls.agg(F.max("callend"), F.count("*")).first()
        width = max(1, -(-((last or 0) + 1) // max(1, min(CELLS, n // PER_CELL))))
        span = F.floor(F.log2((F.col("callend") - F.col("callstart") + 1).cast("double"))).cast("int")
        cell = F.floor(F.col("callstart") / F.greatest(F.lit(width), F.pow(F.lit(2.0), F.col("span") + 1).cast("long"))).cast("int")
        rows = calls.withColumn("span", span).withColumn("cell", cell)
        rows.repartitionByRange("span", "cell", "callstart").sortWithinPartitions("span", "cell", "callstart").write.mode("overwrite").partitionBy("span", "cell").parquet(f"{self.folder}/calls_by_time")
        return width

    def calls_at(self, t: int) -> DataFrame:
        """The calls that are open at idx ``t``, from the two cells of each order of length that can have some; other files aren't read."""
        width = int(self.meta().get("cellwidth", 1))

        def cells(k: int) -> Column:
            wide = max(width, 2 ** (k + 1))
            return (F.col("span") == k) & F.col("cell").between(max(0, t - 2 ** (k + 1) + 1) // wide, t // wide)

        some = cells(0)
        for k in range(1, 62):
            some = some | cells(k)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES["calls"].fields) + ", span int, cell int"
        calls = self.spark.read.schema(schema).parquet(f"{self.folder}/calls_by_time")
        return calls.filter(some).filter((F.col("callstart") <= t) & (F.col("callend") >= t)).drop("span", "cell")

    def meta(self) -> dict[str, str]:
        """Metadata; empty for a folder that isn't a whole store."""
        try:
            return {r["key"]: r["val"] for r in self.table("meta").collect()}
        except AnalysisException:
            return {}

    def up_to_date(self, crc32: str) -> bool:
        """Whether the store was loaded by this version from a trace of this checksum."""
        meta = self.meta()
        return (meta.get("crc32"), meta.get("version")) == (crc32, VERSION)

    def load(self, events: DataFrame, comment: str = "", classes: DataFrame | None = None, crc32: str | None = None, grid: bool = False, **options) -> Store:
        """Loads an event trace: tables, metadata; rows that break an invariant go to ``rejected``. The trace is decoded once, into
        the folder that the cluster shares, and every table is made from that copy, which goes at the end. ``grid`` also keeps the
        results and percentages of the warm-up queries."""
        copy = work_path(self.spark, "events")
        try:
            events = cut(events, copy)
            tables = loader.load(events, **options)
            quarantine = tables.pop("quarantine")
            if classes is not None:
                tables["classdumps"] = classes
            self.write(tables, comment, events.count(), **({"crc32": crc32} if crc32 else {}))
            loader.broken_rows(self.tables()).write.mode("overwrite").parquet(f"{self.folder}/rejected")
            quarantine.write.mode("overwrite").parquet(f"{self.folder}/quarantine")
        finally:
            delete(self.spark, copy)
        if grid:
            self.grid()
        return self

    def query(self, q: Query | str) -> DataFrame:
        return Compiler(self.tables(), self.cache)(q)

    def warm(self, queries: list[Query] | None = None) -> int:
        """Computes and keeps the grid of queries; one compiler shares edges and sub-results. Negations aren't kept."""
        compiler, n = Compiler(self.tables(), self.cache), 0
        for q in series_of_queries() if queries is None else queries:
            if not isinstance(q, Not) and self.cache.get(digest(q)) is None:
                compiler.memo[digest(q)] = self.cache.put(digest(q), compiler(q))
                n += 1
        return n

    def grid(self, queries: list[Query] | None = None) -> DataFrame:
        """The warm-up queries with their object, class and field percentages, kept as statistics: the sets are computed once,
        and then one aggregation a statistic covers all of them."""
        queries = series_of_queries() if queries is None else queries
        self.warm(queries)
        compiler = Compiler(self.tables(), self.cache)
        found = stats.grid_percentages(self.tables(), {digest(q): compiler(q) for q in queries})
        return self.cache.put("grid", found, "statistics")

    def percentages(self, q: Query | str, statistic: str) -> DataFrame:
        """name, total, passed, perc of one query: of ``object``s, by ``class`` or by ``field``; from the kept statistics if they have it."""
        q = parse(q) if isinstance(q, str) else q
        for key in ("grid", digest(q)):
            kept = self.cache.get(key, "statistics")
            if kept is not None and not (rows := kept.filter(F.col("query") == digest(q))).isEmpty():
                break
        else:
            rows = self.cache.put(digest(q), stats.grid_percentages(self.tables(), {digest(q): self.query(q)}), "statistics")
        return rows.filter(F.col("statistic") == statistic).select("name", "total", "passed", "perc")


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """name, objects, date, comment of the stores below ``root``, in one read of all their metadata and one of their objects; other folders
    are left out."""
    name = lambda table: F.regexp_extract("_metadata.file_path", f"/([^/]+)/{table}/[^/]+$", 1)
    at = lambda table: f"{root.rstrip('/')}/*/{table}"
    read = spark.read.option("ignoreCorruptFiles", True)
    try:
        meta = read.schema(META).parquet(at("meta")).select(name("meta").alias("name"), "key", "val")
        objects = read.schema(TABLES["objects"]).parquet(at("objects")).select(name("objects").alias("name"), "id")
    except AnalysisException:  # there is no store
        return spark.createDataFrame([], "name string, objects long, date string, comment string")
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("val"))).alias(key)
    counts = objects.groupBy("name").agg(F.count("id").alias("objects"))
    return meta.groupBy("name").agg(value("date"), value("comment")).join(counts, "name", "left").select("name", F.coalesce("objects", F.lit(0)).alias("objects"), "date", "comment")


def crc32_of(path: str) -> str:
    """Checksum of a trace file, for its metadata; read as a stream."""
    store, at = located(path)
    value = 0
    with store.open_input_stream(at) as f:
        while block := f.read(1 << 20):
            value = zlib.crc32(block, value)
    return f"{value:08x}"
