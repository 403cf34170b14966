import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import bm25, chunking, context, dense, fusion, ingest, metrics, mining, rerank


def words(n):
    return " ".join(f"w{i}" for i in range(n))


@pytest.mark.parametrize("n", [0, 1, 224, 225, 256, 257, 449])
def test_chunks_restore_tokens(spark, n):
    rows = chunking.chunk(spark.createDataFrame([("d", words(n))], "doc_id string, text string")).orderBy("chunk_idx").collect()
    assert len(rows) == -(-n // 224)
    again = [t for r in rows for t in r.chunk_tokens[: 224 if r.chunk_idx < len(rows) - 1 else None]]
    assert again == words(n).split()
    assert all(r.chunk_id == f"d__chunk_{r.chunk_idx}" and r.n_tokens == len(r.chunk_tokens) for r in rows)


def test_chunk_step_with_wide_overlap_and_title(spark):
    d = spark.createDataFrame([("d", "b c d", "A")], "doc_id string, text string, title string")
    assert [r.chunk_text for r in chunking.chunk(d, 2, 5).orderBy("chunk_idx").collect()] == ["a b", "c d"]


TEXTS = {"1": "the cat sat on the mat", "2": "the dog sat", "3": "the bird", "4": "a cat and a cat", "5": "the the the"}


def test_bm25_matches_the_formula(spark):
    c = chunking.chunk(spark.createDataFrame(list(TEXTS.items()), "doc_id string, text string"))
    q = spark.createDataFrame([("q", ["cat", "cat", "the", "unknown"])], "qid string, tokens array<string>")
    got = {r.chunk_id[0]: r.score for r in bm25.Bm25Index.fit(c).search(q).collect()}
    docs = {k: t.split() for k, t in TEXTS.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for t in docs.values() for w in set(t))
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    positive = [x for x in raw.values() if x > 0]
    idf = {w: x if x >= 0 else 0.25 * sum(positive) / len(positive) for w, x in raw.items()}
    assert raw["the"] < 0
    want = {}
    for k, t in docs.items():
        s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in ("cat", "cat", "the") if w in t)
        if s:
            want[k] = s
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)


def test_bm25_saved_index(spark, tmp_path):
    c = chunking.chunk(spark.createDataFrame(list(TEXTS.items()), "doc_id string, text string"))
    index = bm25.Bm25Index.fit(c)
    index.save(f"file://{tmp_path}/i", 2)
    q = bm25.query_tokens(spark.createDataFrame([("q", "Cat on a mat"), ("s", "the of"), ("e", "")], "qid string, query string"))
    a, b = (sorted(map(tuple, i.search(q.select("qid", "tokens")).collect())) for i in (index, bm25.Bm25Index.load(spark, f"file://{tmp_path}/i")))
    assert a == b and {r[0] for r in a} == {"q"}


def test_dense_matches_brute_force_and_lsh_recall(spark):
    import numpy as np

    m = np.random.default_rng(0).normal(size=(300, 16))
    m /= np.linalg.norm(m, axis=1)[:, None]
    v = spark.createDataFrame([(f"{i:03}", x.tolist()) for i, x in enumerate(m)] + [("nul", None)], "chunk_id string, embedding array<float>")
    q = v.where("chunk_id < '005'").withColumnRenamed("chunk_id", "qid")
    got = {}
    for r in dense.search(v, q, 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.chunk_id)
    want = {f"{i:03}": [f"{j:03}" for j in np.argsort(-(m @ m[i]), kind="stable")[:5]] for i in range(5)}
    assert got == want
    assert dense.search(v, q.where("false"), 5).collect() == []
    near = {(r.qid, r.chunk_id) for r in dense.lsh_search(v.where("embedding is not null"), q, 5).collect()}
    assert len(near & {(k, x) for k, xs in want.items() for x in xs}) >= 0.9 * 25


def test_dense_ties_go_to_the_smaller_id(spark):
    v = spark.createDataFrame([(f"{i:02}", [1.0, float(i % 3)]) for i in range(40)], "chunk_id string, embedding array<float>").repartition(3)
    q = spark.createDataFrame([("q", [0.0, 1.0]), ("none", [0.0, 0.0])], "qid string, embedding array<float>")
    got = {}
    for r in dense.search(v, q, 4).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.chunk_id)
    assert got == {"q": ["02", "05", "08", "11"], "none": ["00", "01", "02", "03"]}


def test_fusion(spark):
    lists = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "b", 1), ("q", "c", 2)], "qid string, chunk_id string, rank int")
    got = [(r.chunk_id, r.score) for r in fusion.rrf(lists, ["qid"]).orderBy("rank").collect()]
    assert got == [("b", round(1 / 62 + 1 / 61, 9)), ("a", round(1 / 61, 9)), ("c", round(1 / 62, 9))]
    assert fusion.rrf(lists, ["qid"], top=1).count() == 1
    with pytest.raises(ValueError):
        fusion.two_level([])


def test_two_level_uses_ranks(spark):
    a = spark.createDataFrame([("q", 0, "x", 1), ("q", 0, "y", 2), ("q", 1, "y", 1)], "qid string, variant int, chunk_id string, rank int")
    got = {r.chunk_id: r.score for r in fusion.two_level([a]).collect()}
    assert got == {"y": round(1 / 62 + 1 / 61, 9), "x": round(1 / 61, 9)}


def test_pooling_falls_back_to_the_chunk(spark):
    run = spark.createDataFrame([("q", "a0", 1.0), ("q", "a1", 3.0), ("q", "zz", 2.0)], "qid string, chunk_id string, score double")
    known = spark.createDataFrame([("a0", "a"), ("a1", "a")], "chunk_id string, doc_id string")
    assert [tuple(r)[1:] for r in fusion.to_documents(run, known).orderBy("rank").collect()] == [("a", 3.0, 1), ("zz", 2.0, 2)]


def test_metrics_by_hand(spark):
    qrels = spark.createDataFrame([("1", "a", 2), ("1", "b", 1), ("2", "c", 0), ("3", "d", 1)], "qid string, doc_id string, rel int")
    run = spark.createDataFrame([("1", "x", 1), ("1", "a", 2), ("1", "b", 3), ("2", "c", 1)], "qid string, doc_id string, rank int")
    got = {(r.metric, r.k): r.value for r in metrics.evaluate(qrels, run, (1, 3)).collect()}
    ndcg = (2 / math.log2(3) + 1 / math.log2(4)) / (2 + 1 / math.log2(3))
    assert got[("NDCG", 3)] == pytest.approx(ndcg / 3, abs=1e-6) and got[("NDCG", 1)] == 0
    assert got[("Recall", 3)] == 0.5 and got[("Precision", 3)] == pytest.approx(2 / 3 / 2, abs=1e-6)
    assert got[("MAP", 3)] == pytest.approx((1 / 2 + 2 / 3) / 2 / 2, abs=1e-6) and got[("MRR", 10)] == pytest.approx(0.5 / 3, abs=1e-6)


def test_metrics_without_judgments(spark):
    none = spark.createDataFrame([], "qid string, doc_id string, rel int")
    run = spark.createDataFrame([("1", "x", 1)], "qid string, doc_id string, rank int")
    got = {(r.metric, r.k): r.value for r in metrics.evaluate(none, run, (1, 3)).collect()}
    assert got == {("NDCG", 1): None, ("NDCG", 3): None, ("MRR", 10): None} | {(m, k): 0.0 for m in ("Recall", "MAP", "Precision") for k in (1, 3)}


def test_lambda_loss(spark):
    s, y = [0.2, 1.5, -0.3], [0.5, 1.0, 0.0]
    disc = [1 / math.log2(i + 2) for i in range(3)]
    idcg = sum(v * d for v, d in zip(sorted(y, reverse=True), disc))
    pairs = [(i, j) for i in range(3) for j in range(3) if y[i] > y[j]]
    want = sum(math.log1p(math.exp(s[j] - s[i])) * abs(disc[i] - disc[j]) * (y[i] - y[j]) / idcg for i, j in pairs) / len(pairs)
    rows = [("g", i + 1, s[i], y[i]) for i in range(3)] + [("one", 1, 0.3, 1.0)]
    got = {r.group: r.loss for r in metrics.lambda_loss(spark.createDataFrame(rows, "group string, pos int, score double, label double")).collect()}
    assert got["g"] == pytest.approx(want, abs=1e-6) and got["one"] == 0.0


def test_lambda_loss_of_long_lists(spark, monkeypatch):
    """Cut into tiles, a list has the loss that it has whole."""
    rng = np.random.default_rng(1)
    rows = [(g, i + 1, float(rng.normal()), float(rng.integers(0, 4))) for g, n in ((1, 50), (2, 7), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "group int, pos int, score double, label double")
    whole = {r.group: r.loss for r in metrics.lambda_loss(df).collect()}
    monkeypatch.setattr(metrics, "TILE", 8)
    assert {r.group: r.loss for r in metrics.lambda_loss(df).collect()} == pytest.approx(whole, abs=2e-6) and whole[1] > 0


def test_cut_points(spark):
    df = spark.createDataFrame([(i,) for i in [5, 1, 4, 2, 3, 9, 8, 7, 6]], "v int")
    assert ingest.cut_points(df, "v") == [4, 7]
    assert {r.v: r.b for r in ingest.binned(df, "v", "b").collect()} == {i: (i > 4) + (i > 7) for i in range(1, 10)}


@pytest.mark.parametrize("kind", ["double", "long", "decimal(30,0)", "ties"])
def test_cut_points_by_selection(spark, monkeypatch, kind):
    """Ranges of ranges, down to few values: the same cuts as a sort, at any share of ties and at values of any size."""
    import random
    from decimal import Decimal

    monkeypatch.setattr(ingest, "FEW_VALUES", 20)
    monkeypatch.setattr(ingest, "RANGES", 7)
    rng = random.Random(3)
    make = {
        "double": lambda: rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) * 1e200, float("inf"), -0.0, float("-inf"), 5e-324]),
        "long": lambda: 2**62 + rng.randrange(10_000),  # more than doubles tell apart
        "decimal(30,0)": lambda: Decimal(10**29 + rng.randrange(10**9)),
        "ties": lambda: rng.choice([7, 7, 7, 7, rng.randrange(1000)]),
    }[kind]
    values = [make() for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], f"v {'int' if kind == 'ties' else kind}")
    for parts in (2, 3, 10):
        assert ingest.cut_points(df, "v", parts) == [sorted(values)[len(values) * i // parts] for i in range(1, parts)]
    assert ingest.cut_points(df.where("v is null"), "v") == []


def test_no_task_sorts_all_values(spark):
    plan = ingest.binned(spark.range(10), "id", "b")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_dense_blocks_give_the_same_lists(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = spark.createDataFrame([(f"v{i}", [float(x) for x in rng.normal(size=5)]) for i in range(300)], "chunk_id string, embedding array<float>")
    q = v.limit(40).withColumnRenamed("chunk_id", "qid")
    whole = sorted(map(tuple, dense.search(v, q, 7).collect()))
    monkeypatch.setattr(dense, "BLOCK", 9)
    assert sorted(map(tuple, dense.search(v, q, 7).collect())) == whole and len(whole) == 280


def test_ingest_edges(spark):
    rows = [("a", words(10)), ("b", words(9)), ("c", words(10).upper() + "!"), ("d", None), ("", words(11)), (None, words(12)), ("e", words(10_000)), ("f", words(10_001))]
    got = {r.doc_id for r in ingest.ingest(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a", "e"}


@pytest.mark.parametrize("n", [0, 1, 9, 40])
def test_split_sizes(spark, n):
    q = spark.createDataFrame([(f"q{i}",) for i in range(n)], "qid string")
    got = Counter(r.split for r in ingest.split(q).collect())
    assert (got["train"], got["val"], got["test"]) == (int(n * 0.8), int(n * 0.1), n - int(n * 0.8) - int(n * 0.1))


def test_strata_sizes(spark):
    df = spark.createDataFrame([(str(i), i % 3) for i in range(20)], "id string, s int")
    got = Counter(r.s for r in ingest.sample_strata(df, "id", ["s"]).collect())
    assert got == {0: 4, 1: 4, 2: 3}


def test_hard_negative_zones(spark):
    run = spark.createDataFrame([("q", f"c{i:02}", f"d{i:02}", i + 1) for i in range(60)], "qid string, chunk_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "d02", 0), ("q", "d15", 1)], "qid string, doc_id string, rel int")
    got = [(r.doc_id, r.zone, r.pos) for r in mining.hard_negatives(run, qrels).orderBy("pos").collect()]
    assert got == [("d03", 0, 1), ("d04", 0, 2), ("d05", 0, 3), ("d12", 1, 4), ("d13", 1, 5), ("d32", 2, 6), ("d33", 2, 7)]
    assert mining.quotas(1) == (1, 1, -1) and mining.quotas(7) == (3, 2, 2)


def test_negatives_are_no_positives(spark):
    q = spark.createDataFrame([("1",), ("2",)], "qid string")
    d = spark.createDataFrame([(str(i),) for i in range(12)], "doc_id string")
    p = spark.createDataFrame([("1", str(i)) for i in range(10)], "qid string, doc_id string")
    got = {}
    for r in mining.random_negatives(q, d, p).collect():
        got.setdefault(r.qid, set()).add(r.doc_id)
    assert got["1"] == {"10", "11"} and len(got["2"]) == 5


def test_rerank_guard_and_threshold(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0])], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, embedding array<float>")
    c = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("abc")], "qid string, chunk_id string, rank int")
    assert [r.chunk_id for r in rerank.bi_encoder(c, q, v, 5, min_score=0.0).orderBy("rank").collect()] == ["a", "b"]
    texts = spark.createDataFrame([("a", "x"), ("b", "red fox")], "chunk_id string, chunk_text string")
    qs = spark.createDataFrame([("q", "red fox")], "qid string, query string")
    assert [r.chunk_id for r in rerank.cross_encoder(c, qs, texts, threshold=0.5).collect()] == ["b"]


def test_answers(spark):
    docs = spark.createDataFrame(
        [("q", "d1", "c1", "one two three four", 0.9, 1), ("q", "d1", "c2", "worse", 0.5, 2), ("q", "d2", "c3", "  ", 0.8, 3), ("q", "d3", "c4", "tail", None, 4)],
        "qid string, doc_id string, chunk_id string, chunk_text string, ce_score double, rank int",
    )
    ctx = context.compress(docs, 5, 3)
    assert [(r.chunk_id, r.chunk_text, r.pos) for r in ctx.orderBy("pos").collect()] == [("c1", "one two three …", 1), ("c4", "tail", 2)]
    q = spark.createDataFrame([("q", "what?", "event"), ("none", "x", "general")], "qid string, query string, intent string")
    got = {r.qid: r for r in context.generate(q, ctx, lambda m: F.lit("Answer: based on the context, one four. It is. Yes. No. More.")).collect()}
    squashed = 1 / (1 + 2.718**-0.45)
    assert got["q"].answer == "One four. It is. Yes. No." and not got["q"].fallback and got["q"].used_docs == ["d1", "d3"]
    assert got["q"].confidence == pytest.approx(0.5 * squashed + 0.5 * 1 / 4, abs=1e-6)
    assert (got["none"].answer, got["none"].confidence, got["none"].fallback) == (context.NO_ANSWER, 0.0, True)
    assert "IMPORTANT: The question asks about a SPECIFIC EVENT" in context.prompts(q, ctx).first().messages[0].content


def test_waits_and_models(spark):
    rows = [("429 retry after 3 s", 0, 1.0), ("boom, try again in 9s", 1, -1.0), ("429", 2, 0.0), (None, 0, 0.5)]
    df = spark.createDataFrame(rows, "m string, n int, j double")
    got = [tuple(r) for r in df.select(context.error_kind(F.col("m")), context.retry_wait(F.col("n"), F.col("m"), F.col("j"))).collect()]
    assert got == [("rate_limit", 4.0), ("other", pytest.approx(3.2)), ("rate_limit", 8.0), ("other", pytest.approx(2.2))]
    low, high = spark.range(200).select(context.retry_wait(F.lit(1), F.lit(""), F.rand(3) * 2 - 1).alias("w")).agg(F.min("w"), F.max("w")).first()
    assert 3.2 <= low < high <= 4.8
    kinds = spark.range(1).select(context.error_kind(F.lit("429"), F.lit(403)), context.error_kind(F.lit("429"), F.lit(500), F.lit("APITimeoutError")), context.error_kind(F.lit("x"), None, F.lit("APIConnectionError"))).first()
    assert tuple(kinds) == ("auth", "timeout", "connection")
