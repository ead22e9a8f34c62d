"""Event-time windows, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, column: str = "ts", delay: str | None = None) -> DataFrame:
    """Zone-less times become instants (in the session's zone), which watermarks need."""
    out = events.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, delay) if delay else out


def tumbling_counts(events: DataFrame, keys: list[str], size: str, column: str = "ts") -> DataFrame:
    return _counts(events, keys, F.window(column, size))


def sliding_counts(events: DataFrame, keys: list[str], size: str, slide: str, column: str = "ts") -> DataFrame:
    return _counts(events, keys, F.window(column, size, slide))


def session_counts(events: DataFrame, keys: list[str], gap: str, column: str = "ts") -> DataFrame:
    return _counts(events, keys, F.session_window(column, gap))


def _counts(events: DataFrame, keys: list[str], window) -> DataFrame:
    return events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
