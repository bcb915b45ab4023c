"""Windowed counts over an event stream: an extension, as the dialect has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str = "ts", every: str = "1 hour", late: str = "10 minutes", by: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Count and sum per window and key. On a stream, the watermark bounds the state; on a table
    the same plan runs as a batch."""
    moment = F.col(time).cast("timestamp")
    rows = events.withColumn("_at", moment)
    if rows.isStreaming:
        rows = rows.withWatermark("_at", late)
    out = rows.groupBy(F.window("_at", every), *by).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).cast("double").alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *by, "n", "total")
