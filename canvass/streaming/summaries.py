"""Question summaries over a stream: all of their state is counts, so that they merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, code: str, time: str, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of ``value`` for each code in tumbling or sliding windows; rows later than ``late`` are dropped."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return (
        events.withWatermark(time, late)
        .groupBy(window.alias("w"), F.col(code).alias("code"))
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "code", "n", "total")
    )


def session_counts(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key that a gap parts, with their number of events."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.session_window(time, gap).alias("w"), key)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
    )
