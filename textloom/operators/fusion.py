"""Reciprocal rank fusion on one and two levels, and pooling of chunks to documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import looked_up, top_k


def union(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select(*columns) for f in frames])


def rrf(lists: DataFrame, keys: list[str], k: int = 60, top: int | None = None, item: str = "chunk_id") -> DataFrame:
    """Sum of 1 / (k + rank) over all lists of (keys, item, rank), ranked anew."""
    fused = lists.groupBy(*keys, item).agg(F.round(F.sum(F.lit(1.0).cast("double") / (F.lit(k) + F.col("rank"))), 9).alias("score"))
    return top_k(fused, keys, top, item)


def hybrid(bm25: DataFrame, dense: DataFrame, keys: list[str], k: int = 60, top: int | None = 100) -> DataFrame:
    """One fusion of two ranked lists a key."""
    return rrf(union([bm25, dense], [*keys, "chunk_id", "rank"]), keys, k, top)


def two_level(lists: list[DataFrame], k: int = 60, top: int | None = 100) -> DataFrame:
    """Fuse the lists of each (qid, variant), then the variants' ranks of each qid; not one sum."""
    if not lists:
        raise ValueError("fusion needs at least one source")
    first = rrf(union(lists, ["qid", "variant", "chunk_id", "rank"]), ["qid", "variant"], k, top)
    return rrf(first, ["qid"], k, top)


def to_documents(results: DataFrame, chunk_docs: DataFrame) -> DataFrame:
    """(qid, doc_id, score, rank): the best chunk of each document; an unknown chunk stands for itself."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.col("chunk_id").cast("string"))
    results, chunk_docs = looked_up(results.select("qid", "chunk_id", "score"), chunk_docs.select("chunk_id", "doc_id"))
    r = results.join(chunk_docs, "chunk_id", "left").select("qid", doc.alias("doc_id"), "score")
    return top_k(r.groupBy("qid", "doc_id").agg(F.max("score").alias("score")), ["qid"], None, "doc_id")
