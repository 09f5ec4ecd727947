"""Structured Streaming extension: acquisition-time groups over an unbounded table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def acquisition_groups(events: DataFrame, window: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rows and mean value by event type and time window; windows close when the watermark has passed them. Works on batch and stream alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")
