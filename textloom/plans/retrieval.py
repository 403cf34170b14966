"""Retrieval of all queries at once: variants, two searches, two-level fusion, reranking, enrichment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Retrieval
from ..functions import intent as I
from ..functions import text as T
from ..operators import dense, fusion, rerank
from ..operators.bm25 import Bm25Index, query_tokens
from ..operators.ranking import looked_up


@dataclass
class Corpus:
    """chunks (chunk_id, doc_id, chunk_text), their BM25 index and vectors (chunk_id, embedding)."""

    chunks: DataFrame
    bm25: Bm25Index
    vectors: DataFrame


def understand(queries: DataFrame, n: int = 3, by_intent: bool = True, expand: bool = True) -> DataFrame:
    """queries with intent and variants; without expansion the query alone, intent general."""
    if not expand:
        return queries.withColumn("intent", F.lit("general")).withColumn("variants", F.array(T.normalize_space(F.col("query"))))
    q = queries.withColumn("intent", I.intent(F.col("query")))
    return q.withColumn("variants", I.expand_with_intent(F.col("query"), F.col("intent"), n) if by_intent else I.expand(F.col("query"), n))


def variants(understood: DataFrame) -> DataFrame:
    """(qid, variant, query), one row a variant."""
    return understood.select("qid", F.posexplode("variants").alias("variant", "query"))


def bm25_lists(corpus: Corpus, flat: DataFrame, k: int) -> DataFrame:
    return corpus.bm25.search(query_tokens(flat).select("qid", "variant", "tokens"), k, ["qid", "variant"])


def dense_lists(corpus: Corpus, variant_vectors: DataFrame, k: int) -> DataFrame:
    """Ranked lists of (qid, variant, embedding)."""
    named = variant_vectors.select(F.concat_ws("\u0001", "qid", F.col("variant").cast("string")).alias("qid"), "embedding")
    got = dense.search(corpus.vectors, named, k)
    parts = F.split("qid", "\u0001")
    return got.select(parts[0].alias("qid"), parts[1].cast("int").alias("variant"), "chunk_id", "score", "rank")


def hybrid_multi(corpus: Corpus, understood: DataFrame, variant_vectors: DataFrame, settings: Retrieval = Retrieval()) -> DataFrame:
    """(qid, chunk_id, score, rank) of the two-level fusion over all variants."""
    lists = [bm25_lists(corpus, variants(understood), settings.top_k), dense_lists(corpus, variant_vectors, settings.top_k)]
    return fusion.two_level(lists, settings.rrf_k, settings.top_k)


def enrich(results: DataFrame, chunks: DataFrame, written: bool = True) -> DataFrame:
    """results with doc_id and chunk_text; unknown chunks get empty ones. ``written``: results are written first, so that the chunks stay where they are."""
    known = chunks.select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), "chunk_text")
    if written:
        results, known = looked_up(results, known)
    return results.join(known, "chunk_id", "left").na.fill("", ["doc_id", "chunk_text"])


def retrieve(corpus: Corpus, queries: DataFrame, encode, settings: Retrieval = Retrieval(), scorer: rerank.Scorer = rerank.overlap_scorer, written: bool = False) -> DataFrame:
    """End to end: (qid, intent, doc_id, chunk_id, chunk_text, rrf_score, bi_encoder_score, ce_score, rank).

    ``encode``: (keys, query) frame -> frame with embedding instead of query. The scorer runs on what
    the earlier stages have cut down to. ``written``: each stage's candidates are written before their
    vectors and texts are looked up, so that the corpus stays where it is; otherwise all is one plan.
    """
    understood = understand(queries, settings.n_variants, expand=settings.expand)
    flat = variants(understood)
    fused = hybrid_multi(corpus, understood, encode(flat), settings)
    original = encode(queries.select("qid", F.lit(0).alias("variant"), "query")).select("qid", "embedding")
    # earlier scores travel along, so that each stage is computed once
    fused = fused.withColumn("rrf_score", F.col("score"))
    bi = rerank.bi_encoder(fused, original, corpus.vectors, settings.bi_encoder_top_k, carry=("rrf_score",), written=written)
    ce = rerank.cross_encoder(bi, queries, corpus.chunks, scorer, settings.cross_encoder_top_k, threshold=settings.ce_score_threshold, carry=("rrf_score", "bi_encoder_score"), written=written)
    return enrich(ce.drop("score"), corpus.chunks, written).join(understood.select("qid", "intent"), "qid")
