"""Streaming forms of the event operators: watermarks bound all state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_health(events: DataFrame, window: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Errors and events by service and tumbling window of event time."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("events"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a service: events no further than ``gap`` apart."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"), F.sum("value").alias("total"))


def first_seen(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """Polls without repeats: the first event of a key within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def correlated(alerts: DataFrame, events: DataFrame, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Stream-stream interval join of alerts with the events of their service before them."""
    a = alerts.select(F.col("event_id").alias("alert"), F.col("user_id").alias("service"), F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late)
    e = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", late)
    return a.join(e, F.expr(f"service = user_id and ts <= at and ts >= at - INTERVAL {minutes} MINUTES and event_id <> alert"))
