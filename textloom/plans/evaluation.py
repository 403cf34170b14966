"""Ablation over retrieval stages: one frame of (stage, metric, k, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Evaluation, Retrieval
from ..operators import fusion, rerank
from ..operators.metrics import evaluate
from . import retrieval as R


def stages(corpus: R.Corpus, queries: DataFrame, encode, settings: Retrieval = Retrieval(), scorer: rerank.Scorer = rerank.overlap_scorer, bi_stage: bool = True, keep=DataFrame.persist) -> dict[str, DataFrame]:
    """Ranked chunks of each stage. Without ``bi_stage`` the pair scorer works on the hybrid pool directly.

    ``keep`` holds the lists that several stages read, top_k rows a query each, so that they are made once;
    the caller unpersists the frames returned when done.
    """
    one = queries.withColumn("variants", F.array("query"))
    flat = R.variants(one)
    vectors = encode(flat)
    sparse, close = keep(R.bm25_lists(corpus, flat, settings.top_k)), keep(R.dense_lists(corpus, vectors, settings.top_k))
    several = R.understand(queries, settings.n_variants, by_intent=False)
    multi = keep(R.hybrid_multi(corpus, several, encode(R.variants(several)), settings))
    out = {"BM25": sparse, "Dense": close, "Hybrid": fusion.hybrid(sparse, close, ["qid"], settings.rrf_k, settings.top_k), "HybridMultiQuery": multi}
    pool = multi
    if bi_stage:
        pool = out["MultiHybrid+BiEncoder"] = keep(rerank.bi_encoder(multi, vectors.select("qid", "embedding"), corpus.vectors, settings.bi_encoder_top_k, settings.top_k, settings.bi_encoder_min_score, written=True))
    out["FullPipeline"] = rerank.cross_encoder(pool, queries, corpus.chunks, scorer, settings.cross_encoder_top_k, threshold=None, written=True)
    return out


def ablation(runs: dict[str, DataFrame], chunks: DataFrame, qrels: DataFrame, settings: Evaluation = Evaluation()) -> DataFrame:
    """(stage, metric, k, value) of every stage, chunks pooled to documents."""
    each = [evaluate(qrels, fusion.to_documents(run, chunks), settings.k_values, settings.mrr_k).withColumn("stage", F.lit(name)) for name, run in runs.items()]
    return reduce(DataFrame.unionByName, each).select("stage", "metric", "k", "value")


def deltas(metrics: DataFrame, before: str, after: str) -> DataFrame:
    """(metric, k, before, after, delta) between two stages."""
    a = metrics.where(F.col("stage") == before).select("metric", "k", F.col("value").alias("before"))
    b = metrics.where(F.col("stage") == after).select("metric", "k", F.col("value").alias("after"))
    return a.join(b, ["metric", "k"]).withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


def gap(metrics: DataFrame, settings: Evaluation = Evaluation()) -> DataFrame:
    """One row: NDCG@10 of BM25 less that of dense search, and whether it exceeds the limit."""
    m = metrics.where("metric = 'NDCG' and k = 10")
    value = lambda s: F.max(F.when(F.col("stage") == s, F.col("value")))
    return m.agg(F.round(value("BM25") - value("Dense"), 6).alias("gap")).withColumn("flagged", F.col("gap") > settings.gap)
