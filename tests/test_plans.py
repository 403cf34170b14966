import json

import pytest
from pyspark.sql import functions as F

from textloom.config import Config, Retrieval, from_dict, pick_model
from textloom.operators.bm25 import Bm25Index
from textloom.operators.chunking import chunk
from textloom.plans import evaluation, offline, retrieval
from textloom.sources import readers, writers
from textloom.streaming.ingest import chunk_stream, clean_stream


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([(str(i), " ".join(f"w{(i * j) % 37}" for j in range(1, 60)) + f" topic{i % 4} only{i}") for i in range(24)], "doc_id string, text string")
    c = chunk(docs)
    v = c.select("chunk_id", F.array(*[((F.col("doc_id").cast("int") * (k + 3)) % 11 - 5).cast("float") for k in range(4)]).alias("embedding"))
    return retrieval.Corpus(c, Bm25Index.fit(c), v)


def encode(frame):
    return frame.select(*[c for c in frame.columns if c != "query"], F.array(*[F.lit(float(k)) for k in (1, 2, -1, 0)]).alias("embedding"))


def test_retrieve_end_to_end(spark, corpus):
    q = spark.createDataFrame([("a", "topic1 only5"), ("b", "Who is topic2?")], "qid string, query string")
    got = retrieval.retrieve(corpus, q, encode, Retrieval(top_k=10, bi_encoder_top_k=6, cross_encoder_top_k=3)).collect()
    assert {r.qid: r.intent for r in got} == {"a": "general", "b": "biography"}
    for k in "ab":
        own = sorted((r for r in got if r.qid == k), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3] and own[0].ce_score >= own[2].ce_score and all(r.chunk_text and r.rrf_score > 0 for r in own)
    off = retrieval.retrieve(corpus, q, encode, Retrieval(top_k=10, expand=False)).collect()
    assert {r.intent for r in off} == {"general"}


def test_scorer_sits_above_the_cut(spark, corpus):
    q = spark.createDataFrame([("a", "topic1")], "qid string, query string")
    plan = retrieval.retrieve(corpus, q, encode)._jdf.queryExecution().optimizedPlan().toString()
    # the scorer's word overlap stands above the window that cuts the candidates, and each search is planned once
    lines = plan.splitlines()
    scorer, cut = (next(i for i, x in enumerate(lines) if w in x) for w in ("array_intersect", "windowspecdefinition(qid"))
    assert cut < scorer < max(i for i, x in enumerate(lines) if "windowspecdefinition(qid" in x) and "Cartesian" not in plan
    assert plan.count("MapInArrow") == 1


def test_ablation_and_gap(spark, corpus):
    q = spark.createDataFrame([(str(i), f"only{i}") for i in range(5)], "qid string, query string")
    qrels = q.select("qid", F.col("qid").alias("doc_id"), F.lit(1).alias("rel"))
    for bi, names in ((True, 6), (False, 5)):
        runs = evaluation.stages(corpus, q, encode, Retrieval(top_k=8, bi_encoder_top_k=6, cross_encoder_top_k=4), bi_stage=bi)
        m = evaluation.ablation(runs, corpus.chunks, qrels).cache()
        assert m.select("stage").distinct().count() == names == writers.metric_table(m).count()
        assert m.where("stage = 'BM25' and metric = 'NDCG' and k = 10").first().value == 1.0
        assert evaluation.gap(m).first().flagged
        assert evaluation.deltas(m, "Hybrid", "HybridMultiQuery").count() == 21


def test_offline_build_keeps_complete_stages(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", " ".join(f"a{i}b{j}" for j in range(12 + i))) for i in range(30)], "doc_id string, text string")
    queries = spark.createDataFrame([(f"q{i}", f"a{i}b0") for i in range(10)], "qid string, query string")
    qrels = spark.createDataFrame([(f"q{i}", f"d{i}", 1) for i in range(10)], "qid string, doc_id string, rel int")
    out = f"file://{tmp_path}/o"
    a = offline.build(spark, docs, queries, qrels, out)
    assert 4 <= a["queries"].count() <= 7 and a["docs"].count() >= 15 and a["qrels"].join(a["docs"], "doc_id", "left_anti").count() == 0
    before = sorted(map(tuple, a["docs"].select("doc_id").collect()))
    next((tmp_path / "o" / "chunks").glob("*/_SUCCESS")).unlink()
    b = offline.build(spark, docs, queries, qrels, out)
    assert sorted(map(tuple, b["docs"].select("doc_id").collect())) == before and b["chunks"].count() == len(before)


def chunk_vectors(frame):
    return frame.select("chunk_id", F.array(*[(F.length("chunk_text") % (k + 2)).cast("float") for k in range(4)]).alias("embedding"))


def test_command_line(spark, tmp_path, capsys):
    from textloom.__main__ import main

    at = f"file://{tmp_path}"
    spark.createDataFrame([(f"d{i}", " ".join(f"a{i}b{j}" for j in range(12 + i))) for i in range(30)], "_id string, text string").write.parquet(f"{at}/c")
    spark.createDataFrame([(f"q{i}", f"a{i}b0") for i in range(10)] + [("blank", "  "), ("long", "x" * 1001)], "_id string, text string").write.parquet(f"{at}/q")
    spark.createDataFrame([(f"q{i}", f"d{i}", 1) for i in range(10)], "`query-id` string, `corpus-id` string, score int").write.parquet(f"{at}/r")
    (tmp_path / "s.yaml").write_text("ingest: {sample_ratio: 1.0}\nretrieval: {top_k: 5}\n")
    own = ["--config", str(tmp_path / "s.yaml")]
    main([*own, "build", "--corpus", f"{at}/c", "--queries", f"{at}/q", "--qrels", f"{at}/r", "--index", f"{at}/i", "--encoder", "tests.test_plans:chunk_vectors"])
    assert "docs: 30 rows" in capsys.readouterr().out and offline.load(spark, f"{at}/i").vectors.count() == 30
    main([*own, "retrieve", "--index", f"{at}/i", "--queries", f"{at}/q", "--out", f"{at}/run"])
    said = capsys.readouterr().out
    assert "1 queries refused: empty" in said and "1 queries refused: too_long" in said
    assert {r.qid: r.doc_id for r in spark.read.parquet(f"{at}/run").collect()} == {f"q{i}": f"d{i}" for i in range(10)}
    main([*own, "evaluate", "--run", f"{at}/run", "--qrels", f"{at}/r"])
    assert "|NDCG|1|1.0|" in capsys.readouterr().out.replace(" ", "")


def test_readers(spark, tmp_path):
    raw = spark.createDataFrame([("1", None, "t", "x"), (None, "2", None, None), (None, None, "t", "z")], "_id string, id string, title string, text string")
    assert sorted(map(tuple, readers.corpus(raw).collect())) == [("1", "t", "x"), ("2", "", "")]
    judged = spark.createDataFrame([("q", "d", None), ("q", "e", "2"), (None, "f", "1")], "`query-id` string, `corpus-id` string, score string")
    assert sorted(map(tuple, readers.qrels(judged).collect())) == [("q", "d", 1), ("q", "e", 2)]
    assert readers.is_flattened([], "x-generated-queries") and readers.is_flattened(["query"]) and not readers.is_flattened(["text"], "x")
    flat = spark.createDataFrame([("1", "T", "x", "why"), ("1", "T", "x", "how"), ("2", "", "y", "")], "_id string, title string, text string, query string")
    docs, q, rel = readers.flattened(flat)
    assert docs.count() == 2 and q.count() == 2 and rel.count() == 2
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", "a int").count() == 2


def test_json_maps_round_trip(spark, tmp_path):
    q = spark.createDataFrame([("1", "é \"x\""), ("2", "b")], "qid string, query string")
    writers.write_query_map(q, f"file://{tmp_path}/q")
    assert sorted(map(tuple, readers.read_query_map(spark, f"file://{tmp_path}/q").collect())) == sorted(map(tuple, q.collect()))
    rel = spark.createDataFrame([("1", "d", 2), ("1", "e", 0), ("2", "d", 1)], "qid string, doc_id string, rel int")
    writers.write_qrels_map(rel, f"file://{tmp_path}/r")
    assert sorted(map(tuple, readers.read_qrels_map(spark, f"file://{tmp_path}/r").collect())) == sorted(map(tuple, rel.collect()))


def test_reports(spark, tmp_path):
    path = str(tmp_path / "m.json")
    writers.merge_json(path, "a", {"x": 1})
    assert writers.merge_json(path, "b", {"x": 2}) == json.load(open(path)) == {"a": {"x": 1}, "b": {"x": 2}}
    assert writers.scalars(spark.createDataFrame([(1, [2])], "a int, b array<int>")).columns == ["a"]


def test_config():
    c = from_dict({"retrieval": {"top_k": 7, "unknown": 1}, "evaluation": {"k_values": [1, 2]}})
    assert c.retrieval.top_k == 7 and c.evaluation.k_values == (1, 2) and c.bm25 == Config().bm25
    assert pick_model("fine", "base", True, lambda p: True) == "fine" and pick_model("fine", "base", True, lambda p: False) == "base"


def frame_encoder(path):
    return lambda frame: frame.withColumn("model", F.lit(path))


def test_models_by_flag_and_path(spark, tmp_path):
    from textloom.__main__ import encoder

    (tmp_path / "tuned").mkdir()
    own = {"encoder": "tests.test_plans:frame_encoder", "base": "base", "fine_tuned": f"file://{tmp_path}/tuned"}
    pick = lambda **x: encoder(spark, None, from_dict({"models": {**own, **x}}))
    encode, name = pick()
    assert name.endswith("tuned)") and encode(spark.range(1)).first().model.endswith("tuned")
    assert pick(use_fine_tuned=False)[1].endswith("(base)") and pick(fine_tuned=f"file://{tmp_path}/no")[1].endswith("(base)") and pick(fine_tuned="")[1].endswith("(base)")
    assert encoder(spark, None, Config()) == (None, "") and encoder(spark, "tests.test_plans:chunk_vectors", Config())[0] is chunk_vectors


def test_pair_model_in_place_of_the_scorer(spark, corpus):
    from textloom.operators import rerank
    from textloom.plans.catalog import overlap_model

    queries = spark.createDataFrame([("q", "alpha beta"), ("r", "gamma")], "qid string, query string")
    candidates = corpus.chunks.select("chunk_id").crossJoin(queries.select("qid")).withColumn("rank", F.lit(1))
    rows = lambda **x: sorted(map(tuple, rerank.cross_encoder(candidates, queries, corpus.chunks, k=3, **x).collect()))
    assert rows(model=overlap_model) == rows() != []


def test_streaming_ingest_equals_batch(spark, tmp_path):
    rows = [("a", " ".join(f"x{i}" for i in range(300))), ("b", "too short"), ("c", " ".join(f"X{i}" for i in range(300)) + "."), ("d", " ".join(f"y{i}" for i in range(20)))]
    spark.createDataFrame(rows, "doc_id string, text string").write.parquet(f"file://{tmp_path}/in")
    stream = chunk_stream(clean_stream(spark.readStream.schema("doc_id string, text string").parquet(f"file://{tmp_path}/in")))
    q = stream.writeStream.format("memory").queryName("chunks_out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.doc_id, r.chunk_idx, r.n_tokens) for r in spark.sql("select * from chunks_out").collect()}
    assert ("d", 0, 20) in got and len({i for i, _, _ in got}) == 2 and {n for i, k, n in got if i != "d"} == {256, 76}
