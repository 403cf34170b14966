import pytest
from pyspark.sql import functions as F

from textloom.functions import intent as I
from textloom.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text, want", [("Héllo, Wörld!!  a_b-c\n", "héllo wörld a_b c"), ("...", ""), ("", ""), (None, ""), ("日本 x", "日本 x")])
def test_clean_text(spark, text, want):
    assert one(spark, text, T.clean_text) == want
    assert one(spark, text, T.word_count) == len(want.split())


def test_content_tokens_keep_order_and_duplicates(spark):
    assert one(spark, "The cat and THE cat, of course; isn't it", T.content_tokens) == ["cat", "cat", "course"]


def test_titles(spark):
    df = spark.createDataFrame([("T", "x"), ("", "x"), (None, None)], "t string, x string")
    got = df.select(T.with_title(F.col("t"), F.col("x")), T.titled_lines(F.col("t"), F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("T. x", "T\nx"), ("x", "x"), ("", "")]


def test_sentences_and_words(spark):
    assert one(spark, "One. Two!  Three? four", lambda c: T.first_sentences(c, 2)) == "One. Two!"
    assert one(spark, "a  b\tc d", lambda c: T.truncate_words(c, 2)) == "a b …"
    assert one(spark, "élan vital", T.sentence_case) == "Élan vital"
    assert [one(spark, x, T.is_positive) for x in ("1", "0", "-2", "0.5", "x", None)] == [True, False, False, True, False, False]


DEMO = {
    "What did Trump say about immigration?": "statement", "Who is Joe Biden?": "biography", "What happened at the Capitol on January 6?": "event",
    "Why did the stock market crash in 2008?": "causal", "How did critics react to the healthcare bill?": "opinion", "stock market crash 2008": "general",
    "public reaction to the bill": "statement", "Who won the election?": "general", "how did the talks end": "event", "how did rates lead to a crash": "causal",
}


def test_intents(spark):
    df = spark.createDataFrame([(q,) for q in DEMO], "q string")
    assert {r.q: r.i for r in df.select("q", I.intent(F.col("q")).alias("i")).collect()} == DEMO


def test_expansion(spark):
    with_intent = lambda q: one(spark, q, lambda c: I.expand_with_intent(c, I.intent(c)))
    assert with_intent("What did  Trump say about immigration?") == ["What did Trump say about immigration?", "Trump said stated announced immigration", "Trump statement remarks on immigration"]
    assert with_intent("Who is Joe Biden?") == ["Who is Joe Biden?", "Joe Biden background career history", "Joe Biden role position"]
    assert with_intent("according to reports") == ["according to reports", "according to reports causes", "according to reports impact"]
    assert with_intent("tax cuts") == ["tax cuts", "tax cuts news details", "tax cuts recent developments"]
    assert one(spark, "tax  cuts", lambda c: I.expand(c, 1)) == ["tax cuts"]
    assert one(spark, "tax cuts", lambda c: I.expand(c, 9)) == ["tax cuts", "tax cuts causes", "tax cuts impact", "tax cuts effects", "reasons for tax cuts"]
