"""Nearest neighbours by randomly rotated one-bit codes.

A vector's residual from a centre is rotated at random and kept as one sign bit a dimension, with
two correction scalars: the residual's length and the inner product of the unit residual with its
code. From them the inner product with a query is estimated without bias, within a bound; only
vectors whose lower bound of the distance reaches the best upper bounds are measured exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Stage


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0)
    return df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).where(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("v"), v.alias("exact"))


def _matrix(column, dim: int):
    import numpy as np

    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


def fit_frame(vectors: DataFrame, sample: int, seed: int):
    """(centre, rotation) from at most ``sample`` vectors, chosen by a hash of vec_id; None without vectors.

    The dimension is that of most of them (the smaller on a tie).
    """
    import numpy as np

    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("exact").toArrow().column("exact").to_pylist()
    if not got:
        return None
    sizes = sorted(len(x) for x in got)
    dim = max(dict.fromkeys(sizes), key=sizes.count)
    centre = np.mean([x for x in got if len(x) == dim], axis=0)
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return centre, q * np.sign(np.diag(r))


def encode(vectors: DataFrame, centre, rotation) -> DataFrame:
    """The index: vec_id, code (packed bits), length, match (unit residual times its code), exact."""
    frame, dim = vectors.sparkSession.sparkContext.broadcast((centre, rotation)), len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c, p = frame.value
        for b in batches:
            residual = _matrix(b.column(1), dim) - c
            length = np.sqrt((residual * residual).sum(axis=1))
            turned = residual @ p / np.where(length > 0, length, 1)[:, None]
            bits = turned >= 0
            match = np.abs(turned).sum(axis=1) / math.sqrt(dim)
            code = [x.tobytes() for x in np.packbits(bits, axis=1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code, pa.binary()), pa.array(length), pa.array(match), b.column(1)], ["vec_id", "code", "length", "match", "exact"])

    rows = vectors.where(F.size("exact") == dim).select("vec_id", "exact")
    return rows.mapInArrow(run, "vec_id long, code binary, length double, match double, exact array<double>")


def _best(np, query, vec, dist, k):
    """The k nearest distinct ids of each query, in order of (query, distance, id)."""
    order = np.lexsort((vec, dist, query))
    query, vec, dist = query[order], vec[order], dist[order]
    pair = np.lexsort((np.arange(len(query)), vec, query))
    again = np.zeros(len(query), bool)
    again[pair[1:]] = (query[pair][1:] == query[pair][:-1]) & (vec[pair][1:] == vec[pair][:-1])
    query, vec, dist = query[~again], vec[~again], dist[~again]
    start = np.searchsorted(query, query)
    keep = np.arange(len(query)) - start < k
    return query[keep], vec[keep], dist[keep]


def _search_block(index: DataFrame, shared, dim: int, k: int, sigma: float) -> DataFrame:
    """(query_id, vec_id, score): at least the k nearest of each task. shared: a broadcast of (block, centre, rotation)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        (ids, exact), c, p = shared.value
        residual = exact - c
        q_length = np.sqrt((residual * residual).sum(axis=1))
        turned = (residual @ p / math.sqrt(dim)).T
        query, vec, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        limit = np.full(len(ids), np.inf)  # squared distance that the k-th nearest so far has
        for b in batches:
            own_all, code_all = b.column(0).to_numpy(), b.column(1).to_pylist()
            length_all, match_all, data_all = b.column(2).to_numpy(), b.column(3).to_numpy(), _matrix(b.column(4), dim)
            for lo in range(0, len(own_all), 1024):
                own, length, match, data = own_all[lo : lo + 1024], length_all[lo : lo + 1024], match_all[lo : lo + 1024], data_all[lo : lo + 1024]
                bits = np.unpackbits(np.frombuffer(b"".join(code_all[lo : lo + 1024]), np.uint8).reshape(len(own), -1), axis=1, count=dim)
                safe = np.maximum(match, 1e-9)
                inner = ((bits.astype(np.float64) * 2 - 1) @ turned) * (length / safe)[:, None]
                middle = (length * length)[:, None] + (q_length * q_length)[None, :] - 2 * inner
                error = np.sqrt(np.maximum(1 - safe * safe, 0)) / safe * sigma / math.sqrt(max(dim - 1, 1)) * length
                slack = 2 * error[:, None] * q_length[None, :] + 1e-9
                slack[(match <= 1e-9) | (length == 0)] = np.inf
                high = np.where(own[:, None] == ids[None, :], np.inf, middle + slack)
                if len(own) > k:  # repeated ids may fill the first places, so the bound counts rows only once ids are known to differ
                    if len(np.unique(own)) == len(own):
                        limit = np.minimum(limit, np.partition(high, k, axis=0)[k])
                row, col = np.nonzero((middle - slack <= limit[None, :]) & (own[:, None] != ids[None, :]))
                for at in range(0, len(row), 50_000):
                    r, q = row[at : at + 50_000], col[at : at + 50_000]
                    total = np.zeros(len(r))
                    for j in range(dim):
                        d = data[r, j] - exact[q, j]
                        total += d * d
                    query, vec, dist = _best(np, np.concatenate((query, q)), np.concatenate((vec, own[r])), np.concatenate((dist, np.sqrt(total))), k)
                if len(query):
                    last = np.searchsorted(query, np.arange(len(ids)), side="right") - 1
                    full = np.bincount(query, minlength=len(ids)) >= k
                    limit[full] = np.minimum(limit[full], dist[last[full]] ** 2 * (1 + 1e-12) + 1e-12)
        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(vec), pa.array(dist)], ["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, sample: int = 4096, block: int = 2048, sigma: float = 4.0, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of ``df`` to each row of ``queries``.

    Both hold (vec_id, embedding). Score: the Euclidean distance of the original vectors in double
    precision; ties go to the smaller vec_id. Every row of df is indexed and faces every query, one
    block of about ``block`` queries after the other (of which one is collected and broadcast at a time);
    ``sample`` bounds the vectors that fit the frame and
    ``sigma`` is the error bound's width in standard deviations.

    Null vec_ids and vectors that are null, empty, zero, hold null or non-finite components or
    another dimension than most take no part. A row with the query's vec_id is its own. Repeated
    vec_ids: nearest row counts; of a repeated query the smallest vector. No usable rows: empty.
    Other columns are ignored.
    """
    spark = df.sparkSession
    stage, vectors = Stage(spark, "onebit"), usable(df)
    frame = fit_frame(vectors, sample, seed)
    out = spark.createDataFrame([], "query_id long, vec_id long, score double")
    if frame is not None:
        import numpy as np

        index = stage.put(encode(vectors, *frame))
        asked = usable(queries).where(F.size("exact") == len(frame[0])).groupBy("vec_id").agg(F.min("exact").alias("exact"))
        asked = stage.put(asked)
        blocks = max(1, math.ceil(asked.count() / block))
        shared = None
        for i in range(blocks):
            own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").toArrow()
            ids = own.column("vec_id").to_numpy()
            if len(ids):
                if shared is not None:  # one block is held at a time
                    out = out.unionByName(stage.put(found))
                    shared.unpersist()
                shared = spark.sparkContext.broadcast(((ids, np.array(own.column("exact").to_pylist())), *frame))
                found = _search_block(index, shared, len(frame[0]), k, sigma)
        if shared is not None:
            out = out.unionByName(found)
    near = out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for the rows of ``op8_nearest``: every pair measured.
NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         sqrt(list_reduce(list_transform(list_zip(q.e, v.e), lambda z: (z[2] - z[1]) * (z[2] - z[1])), lambda a, b: a + b)) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""
