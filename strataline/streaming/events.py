"""Extension: the rolling timelines as Structured Streaming over an unbounded table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their sum for each window and kind; events later than `late` are left out."""
    groups = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind)
    return groups.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n", "total")
