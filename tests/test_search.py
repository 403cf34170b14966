"""What a search over all chunks moves and holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import bm25, fusion
from textloom.operators.ranking import Best
from textloom.plans import catalog, retrieval

TABLES = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def chunks(spark, rows):
    return spark.createDataFrame([(f"c{i:02d}", t) for i, t in enumerate(rows)], "chunk_id string, chunk_tokens array<string>")


def test_frequencies_of_a_chunk_stay_in_its_row(spark):
    c = chunks(spark, [["b", "a", "b"], [], ["a"], ["b", "b", "b"]])
    got = bm25.term_frequencies(c)
    assert "Exchange" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [("c00", "a", 1, 3), ("c00", "b", 2, 3), ("c02", "a", 1, 1), ("c03", "b", 3, 3)]


def test_blocks_and_stores_give_the_same_lists(spark, tmp_path, monkeypatch):
    """Queries in blocks, postings from a folder, and the sum by a join, term by term; terms of no weight still count."""
    rng = np.random.default_rng(1)
    c = chunks(spark, [[*rng.choice([f"w{i}" for i in range(12)], int(n)).tolist(), "all"] for n in rng.integers(0, 9, 60)])
    q = spark.createDataFrame([(f"q{i}", i % 2, ["w1", f"w{i}", f"w{i}", "none"] if i else ["all"]) for i in range(9)] + [("empty", 0, [])], "qid string, variant int, tokens array<string>")
    index, keys = bm25.Bm25Index.fit(c), ["qid", "variant"]
    index.terms = index.terms.withColumn("idf", F.when(F.col("term") == "all", 0.0).otherwise(F.col("idf")))
    want = sorted(map(tuple, catalog.ranking.top_k(index.scores(q, keys), keys, 5).collect()))
    assert sorted(map(tuple, index.search(q, 5, keys).collect())) == want and any(x[0] == "q0" for x in want)
    index.save(f"file://{tmp_path}/i", 2)
    monkeypatch.setattr(bm25, "BLOCK", 4)
    monkeypatch.setattr(bm25, "SLAB", 30)
    assert bm25.blocks_of(q, keys) == 3
    for own in (index, bm25.Bm25Index.load(spark, f"file://{tmp_path}/i")):
        assert sorted(map(tuple, own.search(q, 5, keys).collect())) == want


@pytest.mark.parametrize("room", [1, 10_000])
def test_lists_of_a_task(room):
    """Equal scores go to the smaller ids however the items come, and no more than the room waits."""
    rng = np.random.default_rng(3)
    scores, names = np.round(rng.integers(0, 6, (3, 200)) / 7, 6), np.array([f"n{i:03d}" for i in rng.permutation(200)], object)
    best = Best(3, 11, room)
    for a in range(0, 200, 17):
        best.add(scores[:, a : a + 17], lambda i, a=a: names[a + i])
        assert best.fresh <= best.room
    query, item, score = best.lists()
    for q in range(3):
        want = sorted(zip(-scores[q], names))[:11]
        assert [(-s, x) for s, x in zip(score[query == q], item[query == q])] == want


def test_what_an_index_holds_is_not_read_by_others(spark):
    """Chunks of an index are a table: statistics that run later don't read partitions held in executors."""
    catalog.indexed(spark, TABLES)
    try:
        assert "InMemoryTableScan" not in plan(catalog.corpus_statistics(spark, TABLES)) and "InMemoryTableScan" not in plan(catalog.indexed(spark, TABLES)[1].postings)
    finally:
        catalog.release()


def test_queries_after_an_index_read_nothing_held_in_executors(spark):
    """A held partition is read whole by one task: neither the index nor a query over chunks keeps any."""
    names = ["encode_corpus", "inverse_document_frequencies", "enrich_results", "hybrid_rrf"]  # the others of an index share their steps
    held = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    catalog.release()
    before = held()
    try:
        catalog.indexed(spark, TABLES)
        found = {n: "InMemoryTableScan" in plan(catalog.QUERIES[n](spark, TABLES)) for n in names}
        assert [n for n in names if found[n]] == [] and held() <= before
    finally:
        catalog.release()


def test_results_are_looked_up_without_shuffling_the_table(spark):
    """Few results are sent to the chunks; an unknown chunk stays, without a text."""
    rows = spark.range(50_000).selectExpr("concat('c', id) as chunk_id", "id as doc_id", "repeat(cast(id as string), 20) as chunk_text")
    results = spark.createDataFrame([("q", "c7", 2.0), ("q", "c8", 1.0), ("q", "gone", 0.5)], "qid string, chunk_id string, score double")
    got = retrieval.enrich(results, rows)
    assert sorted((r.chunk_id, r.doc_id, len(r.chunk_text)) for r in got.collect()) == [("c7", "7", 20), ("c8", "8", 20), ("gone", "", 0)]
    assert "LeftSemi, BuildRight" in plan(got)
    assert [r.doc_id for r in fusion.to_documents(results, rows).orderBy("rank").collect()] == ["7", "8", "gone"]


def test_judgments_are_made_once(spark):
    try:
        first = catalog.judged(spark, TABLES)
        assert catalog.judged(spark, TABLES) is first and "Join" not in plan(first)
        catalog.release()
        assert catalog.judged(spark, TABLES) is not first  # its table is gone
    finally:
        catalog.release()


def test_candidates_are_scored_without_shuffling_the_corpus(spark):
    """Vectors and texts of few candidates are looked up where they are; the rows are those of one plan."""
    from textloom.operators import rerank

    table = spark.range(50_000).selectExpr("concat('c', id) as chunk_id", "concat('word', id % 7, ' and ', id) as chunk_text", "array(float(id % 5), float(id % 3)) as embedding")
    found = spark.createDataFrame([(q, f"c{i}", i + 1) for q in "ab" for i in range(40)] + [("a", "gone", 41)], "qid string, chunk_id string, rank int")
    queries = spark.createDataFrame([("a", "word3"), ("b", "and 7")], "qid string, query string")
    vectors = spark.createDataFrame([("a", [1.0, 0.5]), ("b", [0.0, 1.0])], "qid string, embedding array<float>")
    for make in (lambda **x: rerank.bi_encoder(found, vectors, table, 9, **x), lambda **x: rerank.cross_encoder(found, queries, table, k=9, **x)):
        got = make(written=True)
        assert "LeftSemi, BuildRight" in plan(got)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, make().collect())) != []


def test_texts_in_place_of_tokens(spark):
    """Frequencies and lists are the same from texts as from arrays; an empty chunk has no term."""
    c = chunks(spark, [["b", "a", "b"], [], ["a", "é"], ["b", "b", "b"], ["", "x"][1:]]).withColumn("text", F.array_join("chunk_tokens", " "))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(bm25.text_frequencies(c)) == rows(bm25.document_frequencies(c)) == [("a", 2), ("b", 2), ("x", 1), ("é", 1)]
    q = spark.createDataFrame([("1", ["a", "b"]), ("2", ["é", "none"])], "qid string, tokens array<string>")
    own = bm25.Bm25Index.fit(c, texts=c.select("chunk_id", "text"))
    assert "Generate" not in plan(own.terms) and rows(own.search(q, 3)) == rows(bm25.Bm25Index.fit(c.drop("text")).search(q, 3)) != []


def test_shared_runs_are_those_of_a_join_by_words(spark, monkeypatch):
    """No run crosses texts, unknown words part runs, and runs of one hash are told apart word by word."""
    from textloom.operators import mining

    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdef"), int(n))) for n in rng.integers(0, 12, 300)] + ["a b c d", "", "zz a b c zz", "a b"]
    asked = [("q1", "a b c".split()), ("q2", "f e d c a".split()), ("q3", ["a"]), ("q4", "a b c".split())]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "doc_id long, text string")
    items = spark.createDataFrame(asked, "qid string, words array<string>")
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    want = sorted((q, i) for q, w in asked for i, t in enumerate(texts) if grams(w) & grams(t.split()))
    monkeypatch.setattr(mining, "SOME", 7)
    assert sorted(map(tuple, mining.shared_runs(docs, items, 3).collect())) == want and len(want) > 20
    same = mining.Runs(asked, 3)
    same.power = same.power * np.uint64(0)  # every run has one hash
    same.key = same.key * np.uint64(0)
    codes = np.array([same.terms.index(w) for w in "a b c".split()])
    places, runs = same.found(codes, np.full(3, 3))
    assert [same.qids[r] for r in runs] == [["q1", "q4"]] and "Exchange" not in plan(mining.shared_runs(docs, items, 3)).split("MapInArrow")[1]
