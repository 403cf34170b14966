"""Versions behind a pointer, and stages that notice what has changed."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.config import Chunking, Config, Ingest
from textloom.plans import offline
from textloom.sources import versions
from textloom.sources.versions import Stages, Versions


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_a_crash_before_the_swap_changes_nothing(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        v.read()
    v.put(spark.range(3), note="first")
    pending = v.write(spark.range(9))  # written, and then the writer is gone
    assert ids(v.read()) == [0, 1, 2] and len(v.history()) == 1
    (tmp_path / "t" / f"{versions.POINTER}.half").write_text("[{")  # a pointer that was never renamed
    assert ids(v.read()) == [0, 1, 2]
    v.publish(pending)
    assert ids(v.read()) == list(range(9)) and [x.get("note") for x in v.history()] == [None, "first"]
    with pytest.raises(FileNotFoundError):
        v.publish(f"file://{tmp_path}/t/nowhere")


def test_readers_keep_their_version(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t")
    v.put(spark.range(1))
    pinned, path = v.read(), v.current()
    v.put(spark.range(2))
    assert ids(pinned) == [0] and ids(spark.read.parquet(path)) == [0] and ids(v.read()) == [0, 1]
    v.put(spark.range(3))  # two versions stay: the first goes
    assert not versions.exists(spark, path) and len(v.history()) == 2


def test_fall_back_and_roll_back(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t")
    v.put(spark.range(1))
    v.put(spark.range(2))
    v.roll_back()
    assert ids(v.read()) == [0]
    v.roll_back()
    assert ids(v.read()) == [0, 1]
    (tmp_path / "t" / v.current().rsplit("/", 1)[1] / "_SUCCESS").unlink()
    assert ids(v.read()) == [0]  # an incomplete version is passed over


def test_older_layouts_are_read(spark, tmp_path):
    spark.range(4).write.parquet(f"file://{tmp_path}/old")
    assert ids(versions.read_first(spark, f"file://{tmp_path}/new", f"file://{tmp_path}/old")) == [0, 1, 2, 3]
    Versions(spark, f"file://{tmp_path}/new").put(spark.range(2))
    assert ids(versions.read_first(spark, f"file://{tmp_path}/new", f"file://{tmp_path}/old")) == [0, 1]
    with pytest.raises(FileNotFoundError):
        versions.read_first(spark, f"file://{tmp_path}/neither")


def tables(spark, tmp_path):
    at = f"file://{tmp_path}"
    return [spark.read.parquet(f"{at}/{x}") for x in ("c", "q", "r")]


def write(spark, tmp_path, docs=30, extra=""):
    at = f"file://{tmp_path}"
    rows = [(f"d{i}", " ".join(f"a{i}b{j}" for j in range(12 + i)) + extra) for i in range(docs)]
    spark.createDataFrame(rows, "doc_id string, text string").coalesce(1).write.mode("overwrite").parquet(f"{at}/c")
    spark.createDataFrame([(f"q{i}", f"a{i}b0") for i in range(10)], "qid string, query string").coalesce(1).write.mode("overwrite").parquet(f"{at}/q")
    spark.createDataFrame([(f"q{i}", f"d{i}", 1) for i in range(10)], "qid string, doc_id string, rel int").coalesce(1).write.mode("overwrite").parquet(f"{at}/r")


EVERY = ["clean", "sample", "docs", "queries", "qrels", "chunks", "bm25"]


def build(spark, tmp_path, config=Config(), **options):
    stages = Stages(spark, f"file://{tmp_path}/o")
    got = offline.build(spark, *tables(spark, tmp_path), f"file://{tmp_path}/o", config, stages=stages, **options)
    return stages.made, got


def encode(frame):
    return frame.select("chunk_id", F.array(F.lit(0.6), F.lit(0.8)).cast("array<float>").alias("embedding"))


def test_only_what_follows_a_change_is_made_again(spark, tmp_path):
    write(spark, tmp_path)
    made, first = build(spark, tmp_path)
    assert made == EVERY and first["docs"].count() >= 15
    assert build(spark, tmp_path)[0] == []
    # settings: a wider window makes chunks anew and what is built on them, not the sample
    wide = Config(chunking=Chunking(max_tokens=8, overlap=2))
    assert build(spark, tmp_path, wide)[0] == ["chunks", "bm25"] and build(spark, tmp_path, wide)[0] == []
    assert build(spark, tmp_path, Config(ingest=Ingest(seed=7), chunking=wide.chunking))[0] == EVERY
    # an encoder adds its stages; another model makes the vectors and their graph anew
    own = Config(ingest=Ingest(seed=7), chunking=wide.chunking)
    assert build(spark, tmp_path, own, encode=encode, model="a")[0] == ["vectors", "graph"]
    assert build(spark, tmp_path, own, encode=encode, model="b")[0] == ["vectors", "graph"]
    assert offline.load_graph(spark, f"file://{tmp_path}/o").search(spark.createDataFrame([("q", [1.0, 0.0])], "qid string, embedding array<float>"), 3).count() == 3
    # judgments alone: the sample and what follows from it, but not the cleaned corpus
    at = f"file://{tmp_path}"
    spark.createDataFrame([("q1", "d1", 2)], "qid string, doc_id string, rel int").coalesce(1).write.mode("overwrite").parquet(f"{at}/r")
    made, _ = build(spark, tmp_path, own)
    assert "clean" not in made and made[0] == "sample" and "qrels" in made
    # the corpus: everything
    write(spark, tmp_path, docs=31)
    made, got = build(spark, tmp_path, own)
    assert made == EVERY and offline.load(spark, f"file://{tmp_path}/o").chunks.count() == got["chunks"].count()


def test_a_build_that_breaks_off_leaves_the_former_one(spark, tmp_path, monkeypatch):
    write(spark, tmp_path)
    build(spark, tmp_path)
    before = sorted(r.chunk_id for r in offline.load(spark, f"file://{tmp_path}/o").chunks.collect())
    write(spark, tmp_path, docs=40, extra=" more words here")
    monkeypatch.setattr(offline, "chunk", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
    for _ in range(3):  # however often it breaks off
        with pytest.raises(RuntimeError):
            build(spark, tmp_path)
    assert sorted(r.chunk_id for r in offline.load(spark, f"file://{tmp_path}/o").chunks.collect()) == before
    assert ids(offline.load(spark, f"file://{tmp_path}/o").bm25.terms.select("term")) != []
    monkeypatch.undo()
    made, got = build(spark, tmp_path)
    assert made == ["chunks", "bm25"]  # what had been made before it broke off stands
    assert sorted(r.chunk_id for r in offline.load(spark, f"file://{tmp_path}/o").chunks.collect()) != before


def test_frames_without_files_count_by_content(spark):
    a = versions.origin(spark.createDataFrame([(1, {"x": 1})], "i int, m map<string, int>"))
    assert a == versions.origin(spark.createDataFrame([(1, {"x": 1})], "i int, m map<string, int>")) and "content" in json.loads(json.dumps(a))
    assert a != versions.origin(spark.createDataFrame([(2, {"x": 1})], "i int, m map<string, int>"))
