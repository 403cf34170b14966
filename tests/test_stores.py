"""JSON maps that tasks share, and an index that a stream keeps up."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import bm25
from textloom.operators.chunking import chunk
from textloom.sources import readers, writers
from textloom.streaming.index import SegmentedIndex
from textloom.streaming.ingest import chunk_stream

QUERIES = {f"q{i}": f"text {i}: é \"quoted\", {{braces}}, back\\slash\nline" for i in range(300)} | {"": "empty id", "k\"ey": "", "d": "plain"}
QRELS = {f"q{i}": {f"d{j}": j % 3 for j in range(i % 7 + 1)} for i in range(300)}
FORMS = [{"indent": 2}, {}, {"separators": (",", ":")}, {"indent": 2, "ensure_ascii": False}]


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("form", FORMS, ids=["indented", "one line", "dense", "plain letters"])
def test_maps_are_shared_by_tasks(spark, tmp_path, small_splits, form):
    (tmp_path / "q.json").write_text(json.dumps(QUERIES, **form))
    (tmp_path / "r.json").write_text(json.dumps(QRELS, **form))
    q = readers.read_query_map(spark, f"file://{tmp_path}/q.json")
    assert {r.qid: r.query for r in q.collect()} == QUERIES and q.count() == len(QUERIES)
    assert len({r[0] for r in q.select(F.spark_partition_id()).collect()}) > 3
    r = readers.read_qrels_map(spark, f"file://{tmp_path}/r.json")
    assert sorted((x.qid, x.doc_id, x.rel) for x in r.collect()) == sorted((a, b, c) for a, docs in QRELS.items() for b, c in docs.items())
    assert len({x[0] for x in r.select(F.spark_partition_id()).collect()}) > 3


@pytest.mark.parametrize("form", FORMS)
def test_maps_whose_texts_look_like_separators(spark, tmp_path, form):
    """What can't be cut is read whole: nothing is lost."""
    odd = QUERIES | {"a": 'ends with ", ', "b": '", "', "c": 'ends with ",', "e": "}", "f": '{"x": "y"}'}
    (tmp_path / "q.json").write_text(json.dumps(odd, **form))
    assert {r.qid: r.query for r in readers.read_query_map(spark, f"file://{tmp_path}/q.json").collect()} == odd
    rel = QRELS | {"a}b": {"d": 1}, "c": {"x},{": 2, "y": 0}}
    (tmp_path / "r.json").write_text(json.dumps(rel, **form))
    got = readers.read_qrels_map(spark, f"file://{tmp_path}/r.json").collect()
    assert sorted((x.qid, x.doc_id, x.rel) for x in got) == sorted((a, b, c) for a, docs in rel.items() for b, c in docs.items())


@pytest.mark.parametrize("parts", [1, 3])
def test_maps_round_trip(spark, tmp_path, parts):
    q = spark.createDataFrame(list(QUERIES.items()), "qid string, query string").repartition(5)
    writers.write_query_map(q, f"file://{tmp_path}/q", parts)
    rel = spark.createDataFrame([(a, b, c) for a, docs in QRELS.items() for b, c in docs.items()], "qid string, doc_id string, rel int").repartition(5)
    writers.write_qrels_map(rel, f"file://{tmp_path}/r", parts)
    for name, want in (("q", QUERIES), ("r", QRELS)):
        files = sorted((tmp_path / name).glob("part-*"))
        whole = [json.loads(f.read_text()) for f in files if f.stat().st_size]
        assert 1 <= len(whole) <= parts and {k: v for x in whole for k, v in x.items()} == want and sum(map(len, whole)) == len(want)
    assert {r.qid: r.query for r in readers.read_query_map(spark, f"file://{tmp_path}/q").collect()} == QUERIES
    assert sorted(map(tuple, readers.read_qrels_map(spark, f"file://{tmp_path}/r").collect())) == sorted(map(tuple, rel.collect()))
    writers.write_query_map(q.limit(0), f"file://{tmp_path}/e")
    assert readers.read_query_map(spark, f"file://{tmp_path}/e").collect() == []


# ---- segments

DOCS = [(f"d{i}", " ".join(f"w{(i * j) % 23}" for j in range(1, 12 + i % 9)) + (" all" if i % 2 else "")) for i in range(60)]


def queries(spark):
    return spark.createDataFrame([(f"q{i}", [f"w{i}", f"w{i + 3}", "all"]) for i in range(12)] + [("none", ["zzz"])], "qid string, tokens array<string>")


def same(spark, segmented, docs):
    whole = bm25.Bm25Index.fit(chunk(spark.createDataFrame(docs, "doc_id string, text string")))
    got = segmented.index()
    assert (got.n, pytest.approx(got.avgdl)) == (whole.n, whole.avgdl)
    assert sorted((r.term, r.df, round(r.idf, 9)) for r in got.terms.collect()) == sorted((r.term, r.df, round(r.idf, 9)) for r in whole.terms.collect())
    assert sorted(map(tuple, got.search(queries(spark), 10).collect())) == sorted(map(tuple, whole.search(queries(spark), 10).collect()))


def test_a_streamed_index_equals_a_batch_index(spark, tmp_path):
    at = f"file://{tmp_path}"
    schema = "doc_id string, text string"
    for i in range(0, 60, 20):
        spark.createDataFrame(DOCS[i : i + 20], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
    segmented = SegmentedIndex(spark, f"{at}/index")
    assert segmented.index().search(queries(spark)).collect() == []
    stream = lambda: chunk_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"))
    segmented.follow(stream(), f"{at}/cp").awaitTermination(120)
    assert len(segmented.segments()) == 3
    same(spark, segmented, DOCS)
    # more documents arrive; the query goes on from its checkpoint and compacts
    more = [(f"n{i}", f"new words w{i} all") for i in range(5)]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
    segmented.follow(stream(), f"{at}/cp", most=3).awaitTermination(120)
    assert len(segmented.segments()) == 1 and segmented.segments()[0]["last"] == 3
    same(spark, segmented, DOCS + more)


def test_a_batch_counts_once(spark, tmp_path):
    segmented = SegmentedIndex(spark, f"file://{tmp_path}/index")
    frame = lambda docs: chunk(spark.createDataFrame(docs, "doc_id string, text string"))
    segmented.append(frame(DOCS[:30]), 0)
    (tmp_path / "index" / "segment-000000000001").mkdir()  # a batch that broke off before the pointer was replaced
    same(spark, segmented, DOCS[:30])
    segmented.append(frame(DOCS[30:]), 1)
    segmented.append(frame(DOCS[30:]), 1)
    segmented.append(frame(DOCS[:1]).limit(0), 2)
    same(spark, segmented, DOCS)
    assert segmented.compact(most=1) and not segmented.compact(most=1)
    segmented.append(frame(DOCS[30:]), 1)  # known by its number, though compacted
    same(spark, segmented, DOCS)
