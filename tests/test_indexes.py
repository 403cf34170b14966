"""The approximate vector index and BM25 by block maxima, against full searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.config import Graph
from textloom.operators import bm25, dense, graph_index
from textloom.operators.block_index import BlockIndex
from textloom.operators.graph_index import GraphIndex

SMALL = Graph(shard=700, links=12, beam=64, entries=24, block=50)


def vectors(spark, points):
    return spark.createDataFrame([(f"v{i}", [float(x) for x in p]) for i, p in enumerate(points)], "chunk_id string, embedding array<float>")


def recall(index, v, queries, k):
    got = {(r.qid, r.chunk_id): (r.score, r.rank) for r in index.search(queries, k).collect()}
    want = {(r.qid, r.chunk_id): (r.score, r.rank) for r in dense.search(v, queries, k).collect()}
    assert len(got) == len(want)
    return len(got.keys() & want.keys()) / len(want), got, want


def units(rng, n, size):
    p = rng.normal(size=(n, size))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["even", "clusters", "copies"])
def test_graph_recall(spark, tmp_path, kind):
    rng = np.random.default_rng(4)
    if kind == "even":
        points = units(rng, 1500, 24)
    else:
        centres = units(rng, 25, 24)
        points = centres[np.arange(1500) % 25] + 0.03 * rng.normal(size=(1500, 24))
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        if kind == "copies":  # a third of all rows is one vector, a tenth another
            points[:500], points[500:650] = points[0], points[500]
    v = vectors(spark, points)
    queries = v.where("pmod(cast(substring(chunk_id, 2) as int), 20) = 3").withColumnRenamed("chunk_id", "qid")
    index = GraphIndex.fit(v, f"file://{tmp_path}/g", SMALL)
    share, got, want = recall(index, v, queries, 10)
    assert share >= 0.95
    assert all(abs(got[x][0] - want[x][0]) <= 2e-6 for x in got.keys() & want.keys())
    again = GraphIndex.load(spark, f"file://{tmp_path}/g", SMALL)
    assert sorted(again.search(queries, 10).collect()) == sorted(index.search(queries, 10).collect())


def test_graph_on_the_tables(spark, tmp_path):
    """The bar for the given vectors: nine in ten of the true neighbours, from a part of the vectors."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    queries = v.where("cast(chunk_id as int) % 100 = 0").withColumnRenamed("chunk_id", "qid")
    index = GraphIndex.fit(v, f"file://{tmp_path}/g", Graph(links=16, beam=48, entries=32))
    assert recall(index, v, queries, 10)[0] >= 0.9
    row = index.shards.first()
    links, data = np.frombuffer(row.links, np.int32).reshape(row.nodes, -1), np.frombuffer(row.vectors, np.float32).reshape(row.nodes, -1)
    looked = graph_index.beams(np, np.array([queries.first().embedding], float), data, links, 48, 32, 4)[2]
    assert 48 <= looked[0] < 0.6 * row.nodes


def test_graph_edges(spark, tmp_path):
    none = GraphIndex.fit(vectors(spark, []), f"file://{tmp_path}/a", SMALL)
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("null", None)], "qid string, embedding array<float>")
    assert none.search(q).collect() == []
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("n", None), ("e", []), ("a", [1.0, 0.0]), ("a", [0.0, -1.0])], "chunk_id string, embedding array<float>")
    index = GraphIndex.fit(v, f"file://{tmp_path}/b", SMALL)
    assert [tuple(r) for r in index.search(q, 2).orderBy("rank").collect()] == [("q", "a", 1.0, 1), ("q", "b", 1.0, 2)]
    assert [tuple(r)[1:] for r in index.search(q, 9).orderBy("rank").collect()] == [("a", 1.0, 1), ("b", 1.0, 2), ("c", 0.0, 3)]
    assert index.search(q.limit(0)).collect() == []


def test_links_join_every_shard(spark, tmp_path):
    """Far clusters of equal vectors still hang together: every node is reached from any other."""
    rng = np.random.default_rng(8)
    centres = units(rng, 6, 8)
    points = np.concatenate([c + 1e-4 * rng.normal(size=(60, 8)) for c in centres])
    row = GraphIndex.fit(vectors(spark, points), f"file://{tmp_path}/g", Graph(shard=10_000, links=6)).shards.first()
    links, seen, todo = np.frombuffer(row.links, np.int32).reshape(row.nodes, -1), {0}, [0]
    while todo:
        todo = [int(x) for i in todo for x in links[i] if x >= 0 and x not in seen and not seen.add(int(x))]
    assert len(seen) == row.nodes == 360


def texts(n):
    rng = np.random.default_rng(2)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(400)]
    return [[*rng.choice(common, 25).tolist(), *rng.choice(rare, 5).tolist()] for _ in range(n)]


@pytest.mark.parametrize("zone", [1, 3, 1000])
def test_blocks_give_the_same_lists(spark, tmp_path, zone):
    rows = texts(400)
    chunks = spark.createDataFrame([(f"x{i:03d}", t) for i, t in enumerate([*rows, rows[0], rows[0], [], ["alone"]])], "chunk_id string, chunk_tokens array<string>")
    index = bm25.Bm25Index.fit(chunks)
    q = spark.createDataFrame([(f"q{i}", rows[i][20:] if i % 2 else [rows[i][-1], rows[i][-1], rows[i][0]]) for i in range(20)] + [("none", []), ("new", ["unknown"]), ("one", ["alone"])], "qid string, tokens array<string>")
    blocks = BlockIndex.fit(index, f"file://{tmp_path}/b", zone, parts=3)
    for k in (1, 7, 500):
        assert sorted(map(tuple, blocks.search(q, k).collect())) == sorted(map(tuple, index.search(q, k).collect()))
    read = blocks.scanned(q, 7).first()
    assert read.scanned <= read.postings == blocks.blocks.join(q.select("qid", F.explode("tokens").alias("term")).distinct(), "term").agg(F.sum("n")).first()[0]
    if zone == 1:
        assert read.scanned < 0.6 * read.postings


def test_blocks_with_keys_and_hot_terms(spark, tmp_path):
    """A term of every chunk, and chunks that are all alike."""
    chunks = spark.createDataFrame([(f"x{i:03d}", ["all", "same"] if i < 200 else ["all", f"t{i}", "rare"][: 2 + (i % 40 == 0)]) for i in range(300)], "chunk_id string, chunk_tokens array<string>")
    index = bm25.Bm25Index.fit(chunks)
    q = spark.createDataFrame([("q", 0, ["all", "rare"]), ("q", 1, ["same"]), ("p", 0, ["t205", "all"])], "qid string, variant int, tokens array<string>")
    blocks = BlockIndex.fit(index, f"file://{tmp_path}/b", 4, parts=2)
    keys = ["qid", "variant"]
    assert sorted(map(tuple, blocks.search(q, 5, keys).collect())) == sorted(map(tuple, index.search(q, 5, keys).collect()))
    assert blocks.blocks.agg(F.max("n")).first()[0] <= 4


def test_graph_with_the_exact_check(spark, tmp_path):
    """Beams alone miss neighbours here; the check adds them, scores and ranks like those of the exact search."""
    v = vectors(spark, units(np.random.default_rng(6), 1500, 24))
    queries = v.where("pmod(cast(substring(chunk_id, 2) as int), 20) = 3").withColumnRenamed("chunk_id", "qid")
    index = GraphIndex.fit(v, f"file://{tmp_path}/g", Graph(shard=700, links=4, beam=10, entries=2, block=50))
    assert recall(index, v, queries, 10)[0] < 1
    assert sorted(map(tuple, index.search(queries, 10, exact=True).collect())) == sorted(map(tuple, dense.search(v, queries, 10).collect()))
