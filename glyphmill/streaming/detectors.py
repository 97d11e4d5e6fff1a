"""Detectors over streams: stateless ones row by row, counts by watermark and window, suppression of repeats.

The reference has no streaming operator; these wrap the same column functions, so a stream and a table agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def language_stream(docs: DataFrame) -> DataFrame:
    """docs (..., text) with language and content hash; works on batch and stream alike."""
    return docs.withColumn("language", T.guess_language(F.col("text"))).withColumn("content_hash", T.content_hash(F.col("text")))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events (ts, event_type, value) counted and summed by window and type; events later than `late` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_seen(docs: DataFrame, ts: str = "ts", keep: str = "1 day") -> DataFrame:
    """Documents whose content hash wasn't seen within the watermark."""
    return language_stream(docs).withWatermark(ts, keep).dropDuplicatesWithinWatermark(["content_hash"])
