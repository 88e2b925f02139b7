"""Event-time windows and sessions, the same expression for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Events and value per tumbling window and type; a stream drops state behind the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.window("ts", size), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """Sessions of a user: events no further apart than the gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), by, "n")
