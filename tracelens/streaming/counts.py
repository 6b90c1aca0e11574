"""Running counts over streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.operators.automata import kind_name


def kind_counts(flat: DataFrame) -> DataFrame:
    """kind, n so far; use output mode complete or update."""
    return flat.groupBy(kind_name().alias("kind")).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """window_start, kind, n for streams that carry clock times: tumbling windows, final once the watermark passed them."""
    held = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return held.select(F.col("w.start").alias("window_start"), "kind", "n")


def progress(flat: DataFrame, name: str = "load") -> DataFrame:
    """``flat`` with observed metrics: events and the last idx of each batch or job."""
    return flat.observe(name, F.count(F.lit(1)).alias("events"), F.max("idx").alias("last_idx"))
