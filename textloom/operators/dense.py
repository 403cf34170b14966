"""Dense retrieval: exact inner products in query blocks, and an approximate index of MLlib."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .ranking import top_k

#: Queries of one block: what each task holds besides a batch of vectors.
BLOCK = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """The unit vector; zero vectors stay."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(size > 0, F.transform(v, lambda x: (x / size).cast("float"))).otherwise(v)


def _search_block(vectors: DataFrame, ids: list, matrix, k: int):
    """(the block's broadcast, k rows a task and query)."""
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))
    qid, item = "string", vectors.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names, queries = shared.value
        query, item, score = np.empty(0, np.int64), np.empty(0, object), np.empty(0)
        limit = np.full(len(names), -np.inf)  # the k-th best score of each query so far
        for b in batches:
            ids = np.array(b.column(0).to_pylist(), object)
            data = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(len(ids), -1)
            scores = np.round(queries @ data.T, 6)
            if len(ids) > k:
                limit = np.maximum(limit, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
            q, i = np.nonzero(scores >= limit[:, None])
            query, item, score = np.concatenate((query, q)), np.concatenate((item, ids[i])), np.concatenate((score, scores[q, i]))
            order = np.lexsort((np.unique(item, return_inverse=True)[1], -score, query))  # ties to the smaller id
            query, item, score = query[order], item[order], score[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            keep = place < k
            query, item, score, place = query[keep], item[keep], score[keep], place[keep]
            full = place == k - 1
            limit[query[full]] = score[full]
        yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in query], pa.string()), pa.array(item.tolist(), b_type), pa.array(score)], ["qid", "chunk_id", "score"])

    b_type = pa.string() if item == "string" else pa.int64()
    return shared, vectors.select("chunk_id", "embedding").mapInArrow(run, f"qid {qid}, chunk_id {item}, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 100) -> DataFrame:
    """(qid, chunk_id, score, rank): the k largest inner products of each query with all vectors.

    vectors: (chunk_id, embedding); queries: (qid string, embedding), in blocks of ``BLOCK``. One block is
    held at a time: its lists are written before the next one is fetched. Each task sends k rows a query at
    most, so the shuffle doesn't grow with the vectors of a task. Null vectors take no part; without
    queries there are no rows.
    """
    import numpy as np

    vectors, queries = vectors.where("embedding is not null"), queries.where("embedding is not null").select("qid", "embedding")
    blocks, out = max(1, math.ceil(queries.count() / BLOCK)), None
    scratch = Scratch(vectors.sparkSession, "dense") if blocks > 1 else None
    if scratch:
        queries = scratch.put(queries)
    for i in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).orderBy("qid").collect()
        if own:
            shared, got = _search_block(vectors, [r[0] for r in own], np.array([r[1] for r in own], float).reshape(len(own), -1), k)
            got = top_k(got, ["qid"], k)
            if scratch:
                got = scratch.put(got)
                shared.unpersist()
            out = got if out is None else out.unionByName(got)
    if out is None:
        return top_k(vectors.where("false").select(F.lit("").alias("qid"), "chunk_id", F.lit(0.0).alias("score")), ["qid"], k)
    return out


def lsh_search(vectors: DataFrame, queries: DataFrame, k: int = 100, bucket: float = 1.0, tables: int = 8, radius: float = 1.2, seed: int = 42) -> DataFrame:
    """The approximate counterpart for unit vectors, by random-projection hashing: misses what no table buckets together."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    v = vectors.select("chunk_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    q = queries.select("qid", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(v)
    near = model.approxSimilarityJoin(v, q, radius, distCol="d")
    near = near.select(F.col("datasetB.qid").alias("qid"), F.col("datasetA.chunk_id").alias("chunk_id"), F.round(1 - F.col("d") * F.col("d") / 2, 6).alias("score"))
    return top_k(near, ["qid"], k)
