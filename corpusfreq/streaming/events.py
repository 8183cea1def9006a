"""Streaming forms: windowed word counts, and distinct adjacent cues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time_col: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n) of tumbling windows; the watermark bounds the state."""
    at = F.col(time_col).cast("timestamp")
    return events.withColumn("_at", at).withWatermark("_at", late).groupBy(F.window("_at", window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def word_stream(docs: DataFrame, tokens) -> DataFrame:
    """Running word counts of a stream of documents, for complete or update mode."""
    return docs.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("count"))
