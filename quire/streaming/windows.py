"""Windowed counts over a stream of events; an extension, the page engine has no streams of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(events: DataFrame, width: str = "1 hour", late: str = "1 day", by: str = "event_type") -> DataFrame:
    """Count and sum of value per window and kind; with a stream, rows later than the watermark are dropped."""
    kind = dict(events.dtypes)["ts"]
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    grouped = timed.groupBy(F.window("ts", width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").cast(kind).alias("start"), by, "n", "total")
