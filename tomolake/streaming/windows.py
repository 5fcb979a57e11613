"""Event-time aggregation of a stream: watermarked windows, and keyed de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, keys: list[str], width: str, late: str, value: str) -> DataFrame:
    """(window, keys, n, total) over tumbling windows; works on streams and on tables."""
    at = events.withWatermark(time, late) if events.isStreaming else events
    return at.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def first_of_key(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    at = events.withWatermark(time, late) if events.isStreaming else events
    return at.dropDuplicatesWithinWatermark([key]) if events.isStreaming else at.dropDuplicates([key])
