import corpus_pipeline
from textloom.llm import queries as Q

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, size string, predicted string, spans string"


def test_stages_on_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None, "x", "x", "x"), (1, "", "en", "a", 0, "x", "x", "x"), (1, "", "en", "a", 0, "x", "x", "x"), (2, "word " * 5000, "en", None, 25000, "x", "x", "x")]
    for docs in (spark.createDataFrame(rows, EXTRA), spark.createDataFrame([], EXTRA)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "/root/testdata/sf0.001")
            path = f"file://{tmp_path}/{docs.count()}-{i}-{len(out.columns)}"
            out.write.parquet(path)
            out = spark.read.parquet(path)
            if i + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == docs.columns
                docs = out


def test_rows_that_stages_keep(spark):
    """Of blank texts one stays, with the smallest id; a text that repeats itself is cut whole; nothing else is lost."""
    rows = [(None, None, None, None, None, "x", "x", "x"), (1, "", "en", "a", 0, "x", "x", "x"), (1, "", "en", "a", 0, "x", "x", "x"), (2, "word " * 5000, "en", None, 25000, "x", "x", "x"), (3, "short text", "en", "a", 10, "x", "x", "x")]
    docs, d = spark.createDataFrame(rows, EXTRA), "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    assert sorted(r.doc_id for r in stages["simhash"](spark, docs, d).collect()) == [1, 2, 3]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in stages["suffix"](spark, docs, d).collect()))) == sorted(map(repr, [(None, None), (1, ""), (1, ""), (2, ""), (3, "short text")]))
    assert stages["benchmark"](spark, docs, d).count() == 5
    assert {(r.doc_id, r.size, r.taken > 0) for r in stages["mixing"](spark, docs, d).collect()} == {(None, 0, False), (1, 0, False), (2, 5000, True), (3, 2, True)}


def test_run_takes_planted_cases(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    bench = spark.read.parquet(f"{src}/benchmark.parquet").first()
    clean = docs.where("lang = 'en' and n_chars between 2000 and 4000").orderBy("doc_id").limit(1).first()
    w = clean.text.split(" ")
    words = [f"v{i}on{i % 13}" for i in range(400)]
    passage = " ".join(words[:60])
    own = lambda k: " ".join(f"k{k}x{i}" for i in range(150))
    planted = [
        (9001, clean.text, "en", "src1", len(clean.text)),
        (9002, " ".join([*w[:40], "other", *w[41:]]), "en", "src1", len(clean.text)),
        (9003, f"{own(3)} {bench.text} {own(4)}.", "en", "src1", 1), (9004, f"{own(5)} {passage} {own(6)}.", "en", "src1", 1), (9005, f"{own(7)} {passage} {own(8)}.", "en", "src1", 1),
    ]
    all_docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    near = {r.doc_id for r in corpus_pipeline.near_copies(spark, all_docs, src).collect()}
    assert 9001 not in near and 9002 not in near and {9003, 9004, 9005} <= near
    texts = {r.doc_id: r.text for r in corpus_pipeline.passages(spark, all_docs, src).where("doc_id > 9003").collect()}
    assert all(passage not in t and "k5x1 " in texts[9004] for t in texts.values())
    assert 9003 not in {r.doc_id for r in corpus_pipeline.benchmark(spark, all_docs, src).collect()}


def test_names():
    assert [q.split("_")[0] for q in Q.QUERIES] == [f"op{n}" for n in range(1, 14)] and set(Q.SQL) <= set(Q.QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
