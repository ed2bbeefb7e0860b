"""Streaming forms of a few operators: an extension, checked against the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """start, kind, n, total of each window; events that come later than the watermark allows are left out. Works on streams and on tables."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks take no time without a zone
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    counts = rows.groupBy(F.window(time, size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counts.select(F.col("w.start").alias("start"), kind, "n", "total")
