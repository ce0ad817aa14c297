"""Structured Streaming forms of the sub-daily metrics, for readings that arrive: site, ts, value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diel_windows(readings: DataFrame, late: str = "1 hour") -> DataFrame:
    """Extremes and mean of each UTC day, closed when the watermark passes it."""
    valid = readings.withWatermark("ts", late).withColumn("value", F.when(F.col("value") >= 0, F.col("value")))
    days = valid.groupBy("site", F.window("ts", "1 day")).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.count("value").alias("n"))
    return days.select("site", F.to_date("window.start").alias("date"), "min", "max", "mean", "n")


def exceedance_sessions(readings: DataFrame, threshold: float, gap: str = "6 days 12 hours", late: str = "1 day") -> DataFrame:
    """Independent exceedances as session windows; on daily dates this gap starts a new event after seven days."""
    above = readings.withWatermark("ts", late).filter(F.col("value") > threshold)
    events = above.groupBy("site", F.session_window("ts", gap)).agg(F.max("value").alias("peak"), F.count(F.lit(1)).alias("n"))
    return events.select("site", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "peak", "n")
