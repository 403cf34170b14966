"""The offline build: raw tables to cleaned sample, splits, chunks and indexes, each stage a table.

A stage is made again where its inputs, settings or an earlier stage have changed, and only there. Readers
find the tables of one build through one pointer, which is replaced when all stages stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import ingest
from ..operators.bm25 import Bm25Index
from ..operators.chunking import chunk
from ..operators.graph_index import GraphIndex
from ..sources.versions import Stages, published, read_first
from ..sources.writers import write_vectors
from .retrieval import Corpus


def build(spark: SparkSession, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, out: str, config: Config = Config(), encode: Callable[[DataFrame], DataFrame] | None = None, model: str = "", stages: Stages | None = None) -> dict[str, DataFrame]:
    """Write and return docs, queries (with split), qrels, chunks.

    The BM25 index is stage ``bm25`` and, with an encoder (a function from (chunk_id, chunk_text) to
    (chunk_id, embedding)), the vectors are stage ``vectors`` and their graph stage ``graph``; ``model`` names
    what encodes, so that another one makes them anew. ``stages``, if given, tells which stages were made.
    """
    s, stages = config.ingest, stages or Stages(spark, out)
    clean = stages.stage("clean", lambda: ingest.ingest(corpus, s.min_words, s.max_words), inputs=(corpus,), settings=s)

    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return df

    def sample() -> DataFrame:
        picked, kept = ingest.stratified_sample(clean, queries, qrels, s.sample_ratio, s.seed, keep=hold)
        one = lambda kind, df, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
        return one("query", picked, "qid").unionByName(one("document", kept, "doc_id"))

    sampled = stages.stage("sample", sample, inputs=(queries, qrels), after=("clean",), settings=s)
    for df in held:
        df.unpersist()
    of = lambda kind, key: sampled.where(F.col("kind") == kind).select(F.col("id").alias(key))
    docs = stages.stage("docs", lambda: clean.join(of("document", "doc_id"), "doc_id", "left_semi"), after=("clean", "sample"))
    own = stages.stage("queries", lambda: ingest.split(queries.join(of("query", "qid"), "qid", "left_semi"), s.train_ratio, s.val_ratio, s.seed), inputs=(queries,), after=("sample",), settings=s)
    judged = stages.stage("qrels", lambda: ingest.restrict(qrels, own, docs), inputs=(qrels,), after=("queries", "docs"))
    chunks = stages.stage("chunks", lambda: chunk(docs, config.chunking.max_tokens, config.chunking.overlap), after=("docs",), settings=config.chunking)
    stages.folder("bm25", lambda path: Bm25Index.fit(chunks, config.bm25).save(path), after=("chunks",), settings=config.bm25)
    if encode is not None:
        made = stages.folder("vectors", lambda path: write_vectors(encode(chunks.select("chunk_id", "chunk_text")), path), after=("chunks",), settings={"model": model})
        stages.folder("graph", lambda path: GraphIndex.fit(spark.read.parquet(made), path, config.graph), after=("vectors",), settings=config.graph)
    stages.publish()
    return {"docs": docs, "queries": own, "qrels": judged, "chunks": chunks}


def load(spark: SparkSession, out: str) -> Corpus:
    """What ``build`` published last, ready for retrieval: one build's tables, whatever is built afterwards.

    Without vectors an empty table of them. A folder of an older layout, without a pointer, is read as it stands.
    """
    at = published(spark, out) or {"chunks": f"{out}/chunks", "bm25": f"{out}/bm25", "vectors": f"{out}/vectors"}
    try:
        vectors = read_first(spark, at["vectors"])
    except (KeyError, FileNotFoundError):
        vectors = spark.createDataFrame([], "chunk_id string, embedding array<float>")
    return Corpus(read_first(spark, at["chunks"]), Bm25Index.load(spark, at["bm25"]), vectors)


def load_graph(spark: SparkSession, out: str, config: Config = Config()) -> GraphIndex:
    """The approximate index of the build that was published last."""
    return GraphIndex.load(spark, published(spark, out)["graph"], config.graph)
