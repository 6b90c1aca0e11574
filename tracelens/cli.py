"""Command line: load a trace, warm or clear the cache, list events, run a query.

    python -m tracelens.cli load --store DIR [--classes DIR] [--comment TEXT] [--grid] [--force] TRACE
    python -m tracelens.cli cache --store DIR [--clear | --clearstat] [--cache]
    python -m tracelens.cli cat TRACE
    python -m tracelens.cli query --store DIR "Deeply(ImmutableObj())"
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tracelens.functions.text import listing, shown
from tracelens.plans.parser import parse
from tracelens.sources.store import Store, crc32_of
from tracelens.sources.trace import read_class_files, read_events, read_trace


def events_of(spark: SparkSession, path: str):
    if path.endswith((".parquet", ".json", ".jsonl")):
        return read_events(spark, path, "parquet" if path.endswith(".parquet") else "json")
    return read_trace(spark, path)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracelens")
    sub = parser.add_subparsers(dest="do", required=True)
    load = sub.add_parser("load")
    load.add_argument("--store", required=True)
    load.add_argument("--classes")
    load.add_argument("--comment", default="")
    load.add_argument("--grid", action="store_true")
    load.add_argument("--force", action="store_true")
    load.add_argument("trace")
    cache = sub.add_parser("cache")
    cache.add_argument("--store", required=True)
    for flag in ("--clear", "--clearstat", "--cache"):
        cache.add_argument(flag, action="store_true")
    sub.add_parser("cat").add_argument("trace")
    query = sub.add_parser("query")
    query.add_argument("--store", required=True)
    query.add_argument("text")
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("tracelens").getOrCreate()
    if a.do == "load":
        store, checksum = Store(spark, a.store), None if a.trace.endswith((".parquet", ".json", ".jsonl")) else crc32_of(a.trace)
        if checksum and not a.force and store.up_to_date(checksum):
            print("up to date")
        else:
            store.load(events_of(spark, a.trace), a.comment, read_class_files(spark, a.classes) if a.classes else None, checksum, a.grid)
    elif a.do == "cache":
        store = Store(spark, a.store)
        if a.clear or a.clearstat:
            store.cache.clear(only_statistics=not a.clear)
        if a.cache:
            print(store.grid().count(), "percentages kept")
    elif a.do == "cat":
        for r in listing(events_of(spark, a.trace)).orderBy("idx").toLocalIterator():
            print(r["line"])
    else:
        q = parse(a.text)
        print(f"objects that {q.explanation()}")
        print(shown(Store(spark, a.store).query(q)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
