"""An approximate index of vectors: proximity graphs, refined by joins, searched by best-first beams.

Vectors are dealt over shards of bounded size by a hash of their ids; equal vectors of a shard are one
node. Each node links to its nearest nodes: neighbour lists start from adjacent places in a few random
projections and get better in rounds, in which all neighbours of a node are compared with each other
(the neighbour of a neighbour is often one's own). A link is left out where a nearer neighbour leads the
same way. Links over wide steps of the projections' order make every shard's graph connected.

A shard is one row: ids, vectors and links. A search broadcasts queries in blocks, walks every shard's
graph for all queries of the block at once, and merges the shards' lists; nothing but k rows a query and
shard is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import Graph
from ..sources.scratch import Scratch
from .ranking import top_k

ROW = "shard int, size int, width int, nodes int, ids array<string>, node_of array<int>, vectors binary, links binary"


def _nodes(vectors: DataFrame, settings: Graph) -> DataFrame:
    """(shard, i, v, ids): the distinct vectors of each shard, numbered from 0; ids of equal ones stand together, at most a shard's."""
    v = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(F.col("chunk_id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("v"))
    shards = max(1, math.ceil(v.count() / settings.shard))
    d = v.groupBy(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return d.select("shard", (F.row_number().over(W.partitionBy("shard").orderBy(F.xxhash64("v"), "v")) - 1).alias("i"), "v", "ids")


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _orders(nodes: DataFrame, settings: Graph) -> DataFrame:
    """(shard, t, i, r): the nodes' places in ``settings.projections`` random projections; a shard's nodes at most are sorted in one task."""
    import random

    d = nodes.select("shard", "i", "v").first()
    size, rng = (len(d["v"]) if d else 0), random.Random(settings.seed)
    along = F.array(*[F.struct(F.lit(t).alias("t"), _dot(F.col("v"), F.array(*[F.lit(rng.gauss(0.0, 1.0)) for _ in range(size)])).alias("x")) for t in range(settings.projections)])
    p = nodes.select("shard", "i", F.inline(along))
    return p.select("shard", "t", "i", (F.row_number().over(W.partitionBy("shard", "t").orderBy("x", "i")) - 1).alias("r"))


def _steps(orders: DataFrame, steps: list[int]) -> DataFrame:
    """(shard, a, b): nodes that lie so many places apart in an order."""
    a = orders.select("shard", "t", F.col("i").alias("a"), F.explode(F.transform(F.array(*map(F.lit, steps)), lambda s: F.col("r") + s)).alias("r"))
    return a.join(orders.withColumnRenamed("i", "b"), ["shard", "t", "r"]).select("shard", "a", "b").distinct()


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct links of each node."""
    best = edges.groupBy("shard", "a", "b").agg(F.max("score").alias("score"))
    return best.withColumn("n", F.row_number().over(W.partitionBy("shard", "a").orderBy(F.desc("score"), "b"))).where(F.col("n") <= k).drop("n")


def _compared(edges: DataFrame, nodes: DataFrame, settings: Graph) -> DataFrame:
    """(shard, a, b, score): pairs among the neighbours of each node that are better than the worst of the list of either.

    Links count in both directions, the best ``2 * links`` of a node, so that no crowded node makes a long list.
    """
    both = edges.unionByName(edges.select("shard", F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    both = _nearest(both, 2 * settings.links)
    worst = edges.groupBy("shard", "a").agg(F.when(F.count("*") >= settings.links, F.min("score")).otherwise(F.lit(-1e300)).alias("worst"))
    member = both.select("shard", F.col("a").alias("at"), F.col("b").alias("i")).join(nodes.select("shard", "i", "v"), ["shard", "i"])
    member = member.join(worst.withColumnRenamed("a", "i"), ["shard", "i"])
    around = member.groupBy("shard", "at").agg(F.collect_list(F.struct("i", "worst", "v")).alias("m")).where(F.size("m") > 1).select("shard", F.col("m.i").alias("i"), F.col("m.worst").alias("worst"), F.flatten("m.v").alias("v"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            shard, first, second, score = [], [], [], []
            for s, i, worst, v in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                i, worst, v = i.values.to_numpy(), worst.values.to_numpy(), v.values.to_numpy().astype(float).reshape(len(i), -1)
                near = np.round(v @ v.T, 6)
                x, y = np.nonzero((near > worst[:, None]) & (i[:, None] != i[None, :]))
                shard.append(np.full(len(x), s))
                first.append(i[x])
                second.append(i[y])
                score.append(near[x, y])
            if shard:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip((shard, first, second, score), (pa.int32(), pa.int32(), pa.int32(), pa.float64()))], ["shard", "a", "b", "score"])

    return around.mapInArrow(pairs, "shard int, a int, b int, score double")


def _scored(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    d = pairs.where("a <> b").join(nodes.select("shard", F.col("i").alias("a"), F.col("v").alias("va")), ["shard", "a"]).join(nodes.select("shard", F.col("i").alias("b"), F.col("v").alias("vb")), ["shard", "b"])
    return d.select("shard", "a", "b", F.round(_dot(F.col("va"), F.col("vb")), 6).alias("score"))


def neighbour_lists(nodes: DataFrame, orders: DataFrame, settings: Graph, scratch: Scratch) -> DataFrame:
    """(shard, a, b, score): about the ``settings.links`` nearest of each node; rounds end when under ``settings.rest`` of the links are new."""
    near = settings.near
    edges = scratch.put(_nearest(_scored(_steps(orders, [s for x in range(1, near + 1) for s in (x, -x)]), nodes), settings.links))
    for _ in range(settings.rounds):
        better = scratch.put(_nearest(edges.unionByName(_compared(edges, nodes, settings)), settings.links))
        known = edges.select("shard", "a", "b", F.lit(1).alias("known"))
        new, every = better.join(known, ["shard", "a", "b"], "left").agg(F.count_if(F.col("known").isNull()), F.count("*")).first()
        edges = better
        scratch.forget(2)  # the links and, before them, the nodes' orders are still read
        if new <= settings.rest * every:
            break
    return edges


@dataclass
class GraphIndex:
    """shards: one row a shard, of ``ROW``."""

    shards: DataFrame
    settings: Graph = Graph()

    @classmethod
    def fit(cls, vectors: DataFrame, path: str, settings: Graph = Graph()) -> GraphIndex:
        """The index of (chunk_id, embedding), written to ``path``. Meant for unit vectors; null or empty ones take no part.

        Of rows that share an id, equal vectors count once, different ones each. Without vectors the index is empty.
        """
        spark = vectors.sparkSession
        held, rounds = Scratch(spark, "graph"), Scratch(spark, "graph-rounds")
        nodes = held.put(_nodes(vectors, settings))
        orders = held.put(_orders(nodes, settings))
        edges = neighbour_lists(nodes, orders, settings, rounds)
        wide = _steps(orders.where("t = 0"), [s for x in range(settings.wide) for s in (4**x, -(4**x))])
        links = edges.groupBy("shard", F.col("a").alias("i")).agg(F.sort_array(F.collect_list(F.struct("score", "b")), asc=False).alias("near"))
        links = nodes.join(links, ["shard", "i"], "left").join(wide.groupBy("shard", F.col("a").alias("i")).agg(F.array_sort(F.collect_set("b")).alias("wide")), ["shard", "i"], "left")
        packed = links.groupBy("shard").applyInArrow(_pack(settings.links), ROW)
        packed.write.mode("overwrite").option("compression", "zstd").parquet(path)
        held.close()
        rounds.close()
        return cls.load(spark, path, settings)

    @classmethod
    def load(cls, spark: SparkSession, path: str, settings: Graph = Graph()) -> GraphIndex:
        return cls(spark.read.schema(ROW).parquet(path), settings)

    def search(self, queries: DataFrame, k: int = 100, exact: bool = False) -> DataFrame:
        """(qid, chunk_id, score, rank): for each query of (qid, embedding) the largest inner products found; approximate.

        ``exact``: a check follows the beams: what of a shard they left out is measured too, and what reaches the
        k-th score found joins the list. It looks at every vector.

        Queries come in blocks of ``settings.block``, one held at a time; each block's lists are written before the next.
        """
        spark = self.shards.sparkSession
        q = queries.where("embedding is not null").select(F.col("qid").cast("string").alias("qid"), F.col("embedding").cast("array<double>").alias("v"))
        blocks, scratch, out = max(1, math.ceil(q.count() / self.settings.block)), Scratch(spark, "graph-search"), None
        q = scratch.put(q.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")))
        for b in range(blocks):
            rows = q.where(F.col("block") == b).orderBy("qid").collect()
            shared = spark.sparkContext.broadcast(([r.qid for r in rows], [r.v for r in rows]))
            found = self.shards.mapInArrow(_walk(shared, k, self.settings, exact), "qid string, chunk_id string, score double")
            # an id with several vectors counts by its best
            got = top_k(found.groupBy("qid", "chunk_id").agg(F.max("score").alias("score")), ["qid"], k)
            if blocks > 1:
                got = scratch.put(got)
                shared.unpersist()
            out = got if out is None else out.unionByName(got)
        return out


def _pack(width: int):
    """A shard's nodes as one row. Of the near links those stay that no nearer kept neighbour leads to (it is nearer to the other end than the node is), then the best others, ``width`` in all."""

    def pack(table: pa.Table) -> pa.Table:
        import numpy as np

        rows = sorted(table.to_pylist(), key=lambda r: r["i"])
        v = np.array([r["v"] for r in rows], np.float32)
        far = [[b for b in r["wide"] or []] for r in rows]
        room = max((len(x) for x in far), default=0)
        links = np.full((len(rows), width + room), -1, np.int32)
        for i, r in enumerate(rows):
            near = [(e["b"], e["score"]) for e in r["near"] or []]
            kept, left = [], []
            for b, score in near:
                (left if kept and (v[kept] @ v[b]).max() > score else kept).append(b)
            mine = list(dict.fromkeys([*kept[:width], *left[: width - len(kept)], *far[i]]))
            links[i, : len(mine)] = mine
        ids = [x for r in rows for x in r["ids"]]
        node_of = [r["i"] for r in rows for _ in r["ids"]]
        columns = [[rows[0]["shard"]], [v.shape[1]], [links.shape[1]], [len(rows)], [ids], [node_of], [v.tobytes()], [links.tobytes()]]
        kinds = [pa.int32()] * 4 + [pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["shard", "size", "width", "nodes", "ids", "node_of", "vectors", "links"])

    return pack


def _walk(shared, k: int, settings: Graph, exact: bool = False):
    """Beams over a shard's graph: all queries of the block go on together, each from its best node that has not been left yet."""
    beam, entries, ahead = max(settings.beam, k), settings.entries, settings.ahead

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names, queries = shared.value
        queries = np.array(queries, float)
        for b in batches:
            for row in b.to_pylist():
                v = np.frombuffer(row["vectors"], np.float32).reshape(row["nodes"], row["size"])
                links = np.frombuffer(row["links"], np.int32).reshape(row["nodes"], -1)
                ids, node_of = np.array(row["ids"], object), np.array(row["node_of"])
                order = np.argsort(node_of, kind="stable")
                starts = np.searchsorted(node_of[order], np.arange(len(v) + 1))
                qid, chunk, score = [], [], []
                for at in range(0, len(queries), 256):
                    q = queries[at : at + 256]
                    nodes, scores, _ = beams(np, q, v, links, beam, entries, ahead)
                    every = np.round(q @ v.T.astype(float), 6) if exact else None
                    for n, (found, own) in enumerate(zip(nodes, scores)):
                        own = np.round(np.where(found >= 0, v[found].astype(float) @ q[n], -np.inf), 6)
                        best = np.argsort(-own, kind="stable")
                        limit = own[best[min(k, len(best)) - 1]]
                        if exact:
                            found = np.nonzero(every[n] >= limit - 1e-6)[0]  # two ways to add up differ by rounding
                            own = every[n][found]
                            best = np.argsort(-own, kind="stable")
                            limit = own[best[min(k, len(best)) - 1]]
                        for f, s in zip(found[best], own[best]):
                            if f < 0 or s < limit:  # ties with the k-th go on, so that ids decide
                                break
                            mine = ids[order[starts[f] : starts[f + 1]]]
                            mine = mine[:k]  # in order of ids; more of a node can't be among the k best
                            qid += [names[at + n]] * len(mine)
                            chunk += mine.tolist()
                            score += [s] * len(mine)
                yield pa.RecordBatch.from_arrays([pa.array(qid, pa.string()), pa.array(chunk, pa.string()), pa.array(score, pa.float64())], ["qid", "chunk_id", "score"])

    return walk


def beams(np, q, v, links, beam: int, entries: int, ahead: int):
    """(nodes, scores, looked): of each query ``beam`` columns, -1 where a beam isn't full, and how many nodes it measured."""
    rows, wide = np.arange(len(q))[:, None], min(beam, len(v))
    start = np.unique(np.linspace(0, len(v) - 1, min(entries, len(v))).astype(int))
    seen = np.zeros((len(q), len(v) + 1), bool)  # the last column stands for no node
    seen[:, -1] = True
    nodes, scores, left = np.full((len(q), wide), -1), np.full((len(q), wide), -np.inf), np.ones((len(q), wide), bool)

    def take(new, own):
        nonlocal nodes, scores, left
        every, all_scores = np.concatenate((nodes, new), 1), np.concatenate((scores, own), 1)
        gone = np.concatenate((left, np.zeros(new.shape, bool)), 1)
        best = np.argpartition(-all_scores, wide - 1, axis=1)[:, :wide]
        nodes, scores, left = every[rows, best], all_scores[rows, best], gone[rows, best] | (all_scores[rows, best] == -np.inf)

    seen[:, start] = True
    take(np.broadcast_to(start, (len(q), len(start))), q @ v[start].T.astype(float))
    while not left.all():
        open_scores = np.where(left, -np.inf, scores)
        some = min(ahead, wide)
        pick = np.argpartition(-open_scores, some - 1, axis=1)[:, :some]
        chosen = np.where(open_scores[rows, pick] > -np.inf, nodes[rows, pick], -1)
        left[rows, pick] = True
        new = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(q), -1)
        new = np.sort(np.where(seen[rows, new], -1, new), axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new = new[:, (new >= 0).any(0)] if (new >= 0).any() else new[:, :0]
        if not new.shape[1]:
            continue
        seen[rows, new] = True
        own = np.einsum("qd,qnd->qn", q, v[new])
        take(new, np.where(new >= 0, own, -np.inf))
    return nodes, scores, seen[:, :-1].sum(axis=1)
