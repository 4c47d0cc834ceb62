"""The stateless operators over a stream of documents, and chunk counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.functions.metadata import text_statistics
from parchmint.functions.text import normalize
from parchmint.operators.splitters import SplitterConfig, split_text


def stream_chunks(docs: DataFrame, splitter_type: str = "paragraph", config: SplitterConfig | None = None) -> DataFrame:
    """Chunks with their statistics of a stream (or table) of doc_id and text: no state, so any output mode will do."""
    clean = docs.select("doc_id", normalize(F.col("text")).alias("text"))
    return split_text(clean, splitter_type, config).withColumn("statistics", text_statistics(F.col("text")))


def windowed_counts(events: DataFrame, time_col: str = "ts", key_col: str = "event_type", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Rows per key in windows of event time; rows later than the watermark are left out."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, size), key_col).agg(F.count("*").alias("n"))
