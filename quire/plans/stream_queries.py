"""Queries on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.proxies import table
from quire.plans.registry import query
from quire.streaming import windows


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts, by the same code that runs on a stream (see tests)."""
    return windows.counted(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
