"""A BM25 index that a stream keeps up: segments of postings, merged when it is asked, compacted when they are many.

Each micro-batch of new chunks becomes a segment: its postings, its terms' document frequencies, its
number of chunks and of words. A pointer lists the segments of the index; it is replaced when a segment
stands, so readers see whole batches, and a batch that is run again after a failure counts once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Bm25
from ..operators import bm25
from ..sources.scratch import Scratch
from ..sources.versions import POINTER, delete, read_json, replace_json


@dataclass
class SegmentedIndex:
    """The index under ``root``. Chunks of later batches are new ones: the stream's deduplication sees to that."""

    spark: SparkSession
    root: str
    settings: Bm25 = Bm25()

    def segments(self) -> list[dict]:
        """path, first and last batch, chunks, words of each segment, oldest first."""
        return read_json(self.spark, f"{self.root}/{POINTER}") or []

    def append(self, chunks: DataFrame, batch: int) -> None:
        """Add a batch of (chunk_id, chunk_tokens); batches that are in already are passed over."""
        now = self.segments()
        if any(s["first"] <= batch <= s["last"] for s in now):
            return
        path = f"{self.root}/segment-{batch:012d}"
        scratch = Scratch(self.spark, "segment")
        held = scratch.put(chunks.select("chunk_id", "chunk_tokens"))
        try:
            n, words = held.agg(F.count("*"), F.coalesce(F.sum(F.size("chunk_tokens")), F.lit(0))).first()
            if n:
                self._write(bm25.term_frequencies(held), bm25.document_frequencies(held), path)
            replace_json(self.spark, f"{self.root}/{POINTER}", [*now, {"path": path, "first": batch, "last": batch, "chunks": n, "words": words}])
        finally:
            scratch.close()

    @staticmethod
    def _write(postings: DataFrame, terms: DataFrame, path: str) -> None:
        by_term = lambda df: df.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").option("compression", "zstd")
        by_term(postings).parquet(f"{path}/postings")
        by_term(terms).parquet(f"{path}/terms")

    def _tables(self, segments: list[dict]) -> tuple[DataFrame, DataFrame]:
        paths = [s["path"] for s in segments if s["chunks"]]
        if not paths:
            return self.spark.createDataFrame([], "term string, chunk_id string, tf long, dl int"), self.spark.createDataFrame([], "term string, df long")
        postings = self.spark.read.parquet(*[f"{p}/postings" for p in paths])
        terms = self.spark.read.parquet(*[f"{p}/terms" for p in paths]).groupBy("term").agg(F.sum("df").alias("df"))
        return postings, terms

    def index(self) -> bm25.Bm25Index:
        """The whole as one index: frequencies added up, idf and the mean length of all chunks so far."""
        segments = self.segments()
        postings, terms = self._tables(segments)
        n, words = sum(s["chunks"] for s in segments), sum(s["words"] for s in segments)
        return bm25.Bm25Index(postings, bm25.idf(terms, n, self.settings.epsilon), n, words / n if n else 0.0, self.settings)

    def compact(self, most: int = 16) -> bool:
        """Make one segment of all where they are more than ``most``; readers of the former ones must be done by the next call."""
        now = self.segments()
        for left in read_json(self.spark, f"{self.root}/replaced.json") or []:
            delete(self.spark, left)
        if len(now) <= most:
            return False
        first, last = now[0]["first"], now[-1]["last"]
        path = f"{self.root}/segments-{first:012d}-{last:012d}"
        self._write(*self._tables(now), path)
        one = {"path": path, "first": first, "last": last, "chunks": sum(s["chunks"] for s in now), "words": sum(s["words"] for s in now)}
        replace_json(self.spark, f"{self.root}/{POINTER}", [one])
        replace_json(self.spark, f"{self.root}/replaced.json", [s["path"] for s in now])
        return True

    def follow(self, chunks: DataFrame, checkpoint: str, most: int = 16, **trigger):
        """Start a query that appends each micro-batch of a streaming (chunk_id, chunk_tokens) frame."""

        def add(batch: DataFrame, number: int) -> None:
            self.append(batch, number)
            self.compact(most)

        return chunks.select("chunk_id", "chunk_tokens").writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
