"""The text operators on streams, with event-time counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import whitespace_tokens


def token_counts(stream: DataFrame, time: str = "ts", text: str = "text", window: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Counts of tokens by event-time window; rows later than the watermark are left out once their window has closed."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    rows = stream.withWatermark(time, late).select(time, F.explode(whitespace_tokens(F.lower(text))).alias("term"))
    return rows.groupBy(w.alias("w"), "term").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "term", "n")


def event_counts(stream: DataFrame, by: str = "event_type", time: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    rows = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by)
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(stream: DataFrame, by: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by)
    return rows.agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
