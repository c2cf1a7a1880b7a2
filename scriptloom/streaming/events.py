"""Streaming extensions: windowed counts with a watermark, and keep-first deduplication, for unbounded event tables.

They are additions on top of the batch operators; the batch and the streaming call share one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """(window_start, kind, n, total) in tumbling windows. On a stream, rows later than `late` are dropped and state is bounded by it; on a table nothing is. `late` None keeps the watermark the stream has."""
    rows = events if late is None else events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming and late else rows
    out = rows.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", "total")


def first_deliveries(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, as first seen."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else rows.dropDuplicates([key])
