"""What the training-data operators share: tables, the shared work folder, text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``. On one machine alone
    a temporary folder will do; on a cluster nothing is guessed."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Shuffle files go as soon as the query that wrote them is done, instead of when the driver next collects garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for the queries that are run inside, put back after them."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame, name: str = "cut", by: tuple[str, ...] = (), onto: DataFrame | None = None) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder, in folders ``by`` some columns or to the rows of ``onto``, and read it back.

    Parquet is a few times smaller than a checkpoint of rows, survives the loss of any executor
    and keeps column pruning for the readers. The shuffle files of ``df`` aren't needed after that and go. The written files live
    as long as the shared folder does, or until ``discard``.
    """
    spark = df.sparkSession
    path = onto.cut_path if onto else f"{shared_dir(spark)}/tracelens/{name}-{uuid.uuid4().hex}"
    with setting(spark, _CLEAN_UP, "true"):
        df.write.mode("append").partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Deletes what ``cut`` wrote; for tables that nothing will read again."""
    for df in cuts:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def blank(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def byte_length(c: Column | str) -> Column:
    """UTF-8 bytes; null counts none."""
    return F.octet_length(blank(c)).cast("long")


def sha_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def md5_uint(c: Column, digits: int = 8) -> Column:
    """The first hex digits of an MD5 as a number; DuckDB can compute the same one."""
    return F.conv(F.substring(F.md5(c), 1, digits), 16, 10).cast("long")


#: Tables of up to this many bytes may be broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST = 32 << 20


def sized(df: DataFrame, row_bytes: int, max_bytes: int = MAX_BROADCAST) -> DataFrame:
    """``df``, a table that was cut, marked for broadcast if its counted rows fit the bound."""
    return F.broadcast(df) if df.count() * row_bytes <= max_bytes else df


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def whole(docs: DataFrame, *keys: Column) -> DataFrame:
    """``keys`` (named) beside one struct ``_row`` of all columns of ``docs``, so that no name of a column can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *keys)


def digest(text: Column | str = "text") -> Column:
    """Tells the texts of one doc_id apart; null counts as empty."""
    return F.xxhash64(blank(text))
