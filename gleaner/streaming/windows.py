"""Event-time windows, the same expressions for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, *, late: str | None = None) -> DataFrame:
    """Counts and sums per hour and type; a stream closes an hour ``late`` after it and drops what comes later still."""
    if late is not None:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of each user, closed by ``gap`` without an event."""
    if late is not None:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def first_events(events: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Events without repeats of their id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
