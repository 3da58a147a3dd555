"""Structured Streaming beside the batch operators: growth of a vocabulary and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.operators.index import occurrences


def term_counts(stream: DataFrame) -> DataFrame:
    """term, cf over a stream of documents (doc_id, text); for the update or complete mode."""
    return occurrences(stream).groupBy("term").agg(F.count(F.lit(1)).alias("cf"))


def event_windows(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """event_type, start, n, total of tumbling windows; events later than the watermark are dropped by Spark."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select("event_type", F.col("window.start").alias("start"), "n", "total")
