"""Incremental ingestion as a stream: an extension of the batch path with the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.chunking import chunk
from ..operators.ingest import length_filter


def clean_stream(docs: DataFrame, low: int = 10, high: int = 10_000, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Length filter and content dedup of a streaming (doc_id, text) frame.

    Which of equal texts comes first is the stream's order. With an event time, hashes older than the
    watermark's delay are forgotten, so that state stays bounded.
    """
    d = length_filter(docs, low, high).withColumn("_hash", T.content_hash(F.col("text")))
    if event_time:
        d = d.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_hash"])
    else:
        d = d.dropDuplicates(["_hash"])
    return d.drop("_hash")


def chunk_stream(docs: DataFrame, max_tokens: int = 256, overlap: int = 32) -> DataFrame:
    """Chunks of a streaming frame; stateless."""
    return chunk(docs, max_tokens, overlap)
