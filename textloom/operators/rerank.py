"""Reranking of truncated candidates by pluggable scorers.

A scorer is a function (query column, text column) -> double column; neural ones are pandas UDFs. The
scorers below are deterministic stand-ins that need no model; they say nothing of a neural model's quality.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .dense import dot
from .encoding import score_pairs
from .ranking import looked_up, top_k

Scorer = Callable[[Column, Column], Column]


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def overlap_logit(query: Column, text: Column) -> Column:
    """Stand-in: 8 times the share of the query's distinct words that the text holds, less 4."""
    q = F.array_distinct(T.tokens(query))
    share = F.size(F.array_intersect(q, F.array_distinct(T.tokens(text)))) / F.greatest(F.size(q), F.lit(1))
    return share * 8.0 - 4.0


def overlap_scorer(query: Column, text: Column) -> Column:
    return sigmoid(overlap_logit(query, text))


def bi_encoder(candidates: DataFrame, query_vectors: DataFrame, vectors: DataFrame, k: int = 80, top_in: int | None = None, min_score: float | None = None, carry: tuple[str, ...] = (), written: bool = False) -> DataFrame:
    """(qid, chunk_id, score, rank, bi_encoder_score, carry) by cosine of unit vectors; the guard comes before the cut.

    ``written``: candidates are written first, so that the vectors stay where they are.
    """
    c = candidates.where(F.col("rank") <= top_in) if top_in else candidates
    c, known = c.select("qid", "chunk_id", *carry), vectors.select("chunk_id", F.col("embedding").alias("_v"))
    if written:
        c, known = looked_up(c, known)
    c = c.join(query_vectors.select("qid", F.col("embedding").alias("_q")), "qid").join(known, "chunk_id")
    c = c.select("qid", "chunk_id", *carry, F.round(dot(F.col("_q"), F.col("_v")), 6).alias("score"))
    if min_score is not None:
        c = c.where(F.col("score") >= min_score)
    return top_k(c, ["qid"], k).withColumn("bi_encoder_score", F.col("score"))


def cross_encoder(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, scorer: Scorer = overlap_scorer, k: int = 50, top_in: int | None = None, threshold: float | None = 0.0, carry: tuple[str, ...] = (), model: Callable | None = None, written: bool = False) -> DataFrame:
    """(qid, chunk_id, score, rank, ce_score, carry): unknown chunks drop out, scores are not fused with earlier ones.

    ``model``, if given, makes a model of ``encoding.score_pairs``, which takes the scorer's place: pairs in batches of similar length.
    ``written``: candidates are written first, so that the chunks' texts stay where they are.
    """
    c = candidates.where(F.col("rank") <= top_in) if top_in else candidates
    c, known = c.select("qid", "chunk_id", *carry), chunks.select("chunk_id", "chunk_text")
    if written:
        c, known = looked_up(c, known)
    c = c.join(queries.select("qid", "query"), "qid").join(known, "chunk_id")
    score = scorer(F.col("query"), F.col("chunk_text"))
    if model is not None:
        c, score = score_pairs(c, model, "query", "chunk_text", name=f"{model.__module__}.{model.__qualname__}", out="_score"), F.col("_score")
    c = c.select("qid", "chunk_id", *carry, F.round(score, 6).alias("score"))
    if threshold is not None:
        c = c.where(F.col("score") >= threshold)
    return top_k(c, ["qid"], k).withColumn("ce_score", F.col("score"))
