"""Overlapping token windows over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def windows(tokens: Column, max_tokens: int = 256, overlap: int = 32) -> Column:
    """Array of token windows that start every max_tokens - overlap tokens; none for no tokens.

    The last windows may lie wholly within their predecessor: windows start as long as tokens are left.
    """
    step = max_tokens - overlap if max_tokens > overlap else max_tokens
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(step)))
    return F.transform(F.coalesce(starts, F.expr("cast(array() as array<int>)")), lambda s: F.slice(tokens, s + 1, max_tokens))


def chunk(docs: DataFrame, max_tokens: int = 256, overlap: int = 32) -> DataFrame:
    """chunk_id, doc_id, chunk_idx, chunk_text, n_tokens, chunk_tokens of documents (doc_id, text[, title])."""
    title = F.col("title") if "title" in docs.columns else F.lit("")
    d = docs.select("doc_id", T.tokens(T.with_title(title, F.col("text"))).alias("_t"))
    d = d.select("doc_id", F.posexplode(windows(F.col("_t"), max_tokens, overlap)).alias("chunk_idx", "chunk_tokens"))
    return d.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("__chunk_"), F.col("chunk_idx").cast("string")).alias("chunk_id"), "doc_id", "chunk_idx",
        F.array_join("chunk_tokens", " ").alias("chunk_text"), F.size("chunk_tokens").alias("n_tokens"), "chunk_tokens",
    )


def first_chunks(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_text) of each document's first chunk."""
    return chunks.where("chunk_idx = 0").select("doc_id", "chunk_text")
