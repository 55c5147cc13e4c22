"""Structured Streaming forms of the sequence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """Watermarked events; times without a zone are taken in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums of each window; a window closes once the watermark passes it."""
    w = _timed(events, time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Runs of events no further apart than gap."""
    w = _timed(events, time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
