"""Encoding, pair scoring and generation, which run models and clients within tasks."""

import math

import pytest
from pyspark.sql import functions as F

from textloom.operators import context, encoding, generation

TEXTS = [(i, None if i % 17 == 0 else " ".join(["word"] * (i * 7 % 90 + 1)) + f" {i}") for i in range(200)]


def counting():
    return lambda texts: [[float(len(t)), float(t.count("o")), 1.0] for t in texts]


def narrow():
    """A model that holds three texts at most, or sixty words."""

    def run(texts):
        if len(texts) > 3 or (len(texts) > 1 and sum(t.count(" ") + 1 for t in texts) > 60):
            raise MemoryError
        return [[float(len(t)), 0.0, 0.0] for t in texts]

    return run


def test_encode_keeps_rows_and_order(spark):
    df = spark.createDataFrame(TEXTS, "id int, text string").repartition(3)
    for unit in (False, True):
        got = {r.id: r.embedding for r in encoding.encode(df, counting, ["id"], "text", name="counting", room=40, most=5, unit=unit, kind="double").collect()}
        for i, t in TEXTS:
            want = [float(len(t or "")), float((t or "").count("o")), 1.0]
            size = math.sqrt(sum(x * x for x in want)) if unit else 1.0
            assert got[i] == pytest.approx([x / size for x in want], abs=1e-12)
    assert encoding.encode(df.limit(0), counting, ["id"], "text").collect() == []


def test_batches_that_do_not_fit_are_split(spark):
    df = spark.createDataFrame(TEXTS, "id int, text string").repartition(2)
    got = {r.id: r.embedding for r in encoding.encode(df, narrow, ["id"], "text", name="narrow", unit=False).collect()}
    assert got == {i: [float(len(t or "")), 0.0, 0.0] for i, t in TEXTS}


def test_halving_stops_at_single_items():
    calls = []

    def fits(items):
        calls.append(len(items))
        if len(items) > 1:
            raise MemoryError
        if items[0] == "never":
            raise MemoryError
        return [x * 2 for x in items]

    assert encoding.halving(fits, [1, 2, 3]) == [2, 4, 6]
    with pytest.raises(MemoryError):
        encoding.halving(fits, ["never"])
    with pytest.raises(ValueError):  # only memory is a reason to try again
        encoding.halving(lambda items: (_ for _ in ()).throw(ValueError()), [1, 2])


def test_padded_batches():
    lengths = sorted([1, 1, 1, 2, 2, 30, 30, 31, 500])
    ranges = encoding.padded_batches(lengths, 60, 3)
    assert [x for a, b in ranges for x in lengths[a:b]] == lengths
    for a, b in ranges:
        assert b - a <= 3 and ((b - a) * lengths[b - 1] <= 60 or b - a == 1)
    assert encoding.padded_batches([], 10, 3) == []


def test_parts_go_on_where_a_run_broke_off(spark, tmp_path):
    path = f"file://{tmp_path}/parts"
    df = spark.createDataFrame(TEXTS, "id int, text string")

    def broken():
        def run(texts):
            if any(t.endswith(" 33") for t in texts):
                raise RuntimeError("gone")
            return counting()(texts)

        return run

    with pytest.raises(Exception, match="gone"):
        encoding.encode_parts(df, broken, ["id"], "text", path, parts=4, name="broken", unit=False)
    written = sorted(p.parent.name for p in (tmp_path / "parts").glob("*/_SUCCESS"))
    times = {p: p.stat().st_mtime_ns for p in (tmp_path / "parts").glob("*/_SUCCESS")}
    got = encoding.encode_parts(df, counting, ["id"], "text", path, parts=4, name="counting", unit=False)
    assert {r.id for r in got.collect()} == {i for i, _ in TEXTS} and got.count() == len(TEXTS)
    assert len(written) < 4 and all(p.stat().st_mtime_ns == t for p, t in times.items())  # what stood was not made again


def test_pair_scores_and_padding(spark):
    def model():
        return lambda pairs: [len(q) + len(t) / 1000 for q, t in pairs]

    df = spark.createDataFrame([(i, "q" * (i % 5), t) for i, t in TEXTS], "id int, query string, text string")
    got = encoding.score_pairs(df, model, "query", "text", name="pairs", room=100, most=7)
    assert {r.id: r.score for r in got.collect()} == {i: i % 5 + len(t or "") / 1000 for i, t in TEXTS} and got.columns == [*df.columns, "score"]
    saved = encoding.padding(df.select((F.length("text")).alias("n")).na.fill(0).coalesce(1), "n", room=10_000, most=16).first()
    assert saved.words <= saved.dealt < 0.6 * saved.plain


# ---- generation


class Status(Exception):
    def __init__(self, code, text=""):
        super().__init__(text)
        self.status_code = code


class ReadTimeout(Exception):
    pass


ERRORS = [Status(429), Status(401, "429"), Status(402), ReadTimeout("x"), ConnectionError("quota"), RuntimeError("Rate limit; retry after 3.5 s"), RuntimeError("INVALID API KEY"), RuntimeError("deadline"), RuntimeError("boom"), Status(500, "insufficient_quota")]


def test_kinds_and_waits_are_those_of_the_columns(spark):
    rows = [(i, str(e), getattr(e, "status_code", None), type(e).__name__) for i, e in enumerate(ERRORS)]
    df = spark.createDataFrame(rows, "i int, m string, s int, e string")
    kind = context.error_kind(F.col("m"), F.col("s"), F.col("e"))
    got = df.select("i", kind.alias("kind"), context.retry_wait(F.col("i") % 3, F.col("m"), kind=kind).alias("wait")).collect()
    for r in got:
        assert (r.kind, r.wait) == (generation.kind_of(ERRORS[r.i]), generation.wait_before(r.i % 3, ERRORS[r.i]))


def run(spark, rows, client, policy, **options):
    df = spark.createDataFrame([(i, [("user", t)] if t is not None else None) for i, t in rows], "id int, m array<struct<role: string, content: string>>")
    return {r.id: (r.text, r.model, r.tries, r.waited, r.error) for r in generation.complete(df, "id", "m", client, policy, sleep=lambda s: None, **options).collect()}


def failing():
    seen = {}

    def call(model, messages):
        text = messages[0]["content"]
        seen[model, text] = n = seen.get((model, text), 0) + 1
        if text == "limited" and n < 3:
            raise RuntimeError("429, try again in 30s")
        if text == "dead" or (text == "first dead" and model == "a"):
            raise ConnectionError("reset")
        if text == "key":
            raise RuntimeError("unauthorized")
        return "" if text == "empty once" and n == 1 else f"{model}:{text}"

    return call


def test_models_retries_and_final_errors(spark):
    rows = list(enumerate(["fine", "limited", "dead", "first dead", "key", "empty once", None]))
    got = run(spark, rows, failing, generation.Policy(("a", "b"), tasks=2, jitter=0.0, give_up=False))
    assert got == {
        0: ("a:fine", "a", 1, 0.0, None), 1: ("a:limited", "a", 3, 62.0, None), 2: (None, None, 6, 12.0, "connection"), 3: ("b:first dead", "b", 4, 6.0, None),
        4: (None, "a", 1, 0.0, "auth"), 5: ("a:empty once", "a", 2, 2.0, None), 6: (None, None, 0, 0.0, None),
    }
    spread = run(spark, rows, failing, generation.Policy(("a", "b"), tasks=2, jitter=0.2, give_up=False))
    assert spread == run(spark, rows, failing, generation.Policy(("a", "b"), tasks=2, jitter=0.2, give_up=False))
    assert 0.8 * 12 <= spread[2][3] <= 1.2 * 12 and spread[2][3] != 12.0


def test_a_final_error_ends_its_task(spark):
    got = run(spark, [(i, "key") for i in range(30)], failing, generation.Policy(("a",), tasks=1))
    assert sum(x[2] for x in got.values()) == 1 and {x[4] for x in got.values()} == {"auth"}


def test_the_rate_is_shared():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = generation.Pace(0.5, lambda: now[0], sleep)
    for _ in range(4):
        pace.wait()
    assert slept == [0.5, 0.5, 0.5]
    now[0] += 10
    pace.wait()
    assert len(slept) == 3


def test_generated_answers_take_part(spark):
    queries = spark.createDataFrame([("q", "who", "general"), ("r", "why", "general")], "qid string, query string, intent string")
    docs = spark.createDataFrame([("q", "d", "c", "Some facts here. More.", 1.0, 1), ("r", "d", "c", "Some facts here. More.", 1.0, 1)], "qid string, doc_id string, chunk_id string, chunk_text string, ce_score double, rank int")
    found = context.compress(docs)

    def client():
        def call(model, messages):
            if "why" in messages[1]["content"]:
                raise ConnectionError("reset")
            return "answer: according to the context, it is so."

        return call

    raw = generation.complete(context.prompts(queries, found), "qid", "messages", client, generation.Policy(("a",), tasks=2), sleep=lambda s: None)
    got = {r.qid: (r.answer, r.fallback) for r in context.generate(queries, found, completed=raw).collect()}
    assert got == {"q": ("It is so.", False), "r": ("Some facts here. More.", True)}
