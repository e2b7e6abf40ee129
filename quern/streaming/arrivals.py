"""Streaming extensions: censuses of arrivals, and waves split at gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arrival_census(stream: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and key; windows close when the watermark passes them."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), key, "events")


def streaming_waves(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key, split where the gap is over `gap`."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), "events")
