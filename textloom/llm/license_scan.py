"""License scans by diagonal voting. DataFrame functions only.

All rolling word k-grams of the texts are joined by hash to the positions of license templates.
Every hit votes for a diagonal, its text position less its template position. Votes are summed by
(text, template, diagonal). Diagonals that are neighbours by number (insertions and deletions shift
them) make a band, whatever stray ones a template's repeated phrases add elsewhere; within a band,
stretches of the text that lie close together are merged, and a merged span counts if it holds enough
of its template.

The texts are read and split into words once. While the templates are few enough to broadcast, k-grams
that are no template's are passed over before any row is made of them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Stage, spread_join
from .license_texts import PHRASES, TEMPLATES

#: What separates the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a lower-cased text; this form of the class is the one Java matches fast.
BETWEEN = r"[^a-z0-9\x80-\x{10ffff}]+"
K = 4  # words of a k-gram; a shorter template is one k-gram
#: Words of templates that are broadcast at most; more are joined by a shuffle.
FEW = 100_000


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _bodies(phrases: dict[str, str], templates: list[tuple[str, str]]) -> list[tuple[int, str, bool, list[str]]]:
    """(template, label, base, words): the phrases, then the templates, in order."""
    out = [(t, label, base, template_words(text)) for t, (label, text, base) in enumerate([(v, k, True) for k, v in phrases.items()] + [(a, b, False) for a, b in templates])]
    if short := [" ".join(w) for *_, w in out if len(w) < 2]:
        raise ValueError(f"a template needs two words: {short}")
    return out


def _key(words: list):
    return F.xxhash64(F.lit(len(words)), *words)


def template_grams(spark: SparkSession, bodies) -> DataFrame:
    """A row for each k-gram position: template, label, base, length, grams, at, gram (its words, spaced), key."""
    t = spark.createDataFrame([(a, b, c, d) for a, b, c, d in bodies], "template int, label string, base boolean, words array<string>")
    t = t.withColumn("length", F.size("words")).withColumn("k", F.least(F.lit(K), F.size("words")))
    t = t.withColumn("grams", F.col("length") - F.col("k") + 1)
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)).alias("at"))
    word = lambda i: F.get("words", F.col("at") + i)
    key = F.coalesce(*[F.when(F.col("k") == k, _key([word(i) for i in range(k)])) for k in range(2, K + 1)])
    return t.select("template", "label", "base", "length", "grams", "at", F.array_join(F.slice("words", F.col("at") + 1, F.col("k")), " ").alias("gram"), key.alias("key"))


def scan(df: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, coverage: float = 0.6, drift: int = 3, gap: int = 8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of (doc_id, text).

    A-Z are lower-cased. n_base counts all places of ``phrases``; first_word and last_word are the
    smallest and largest of their starts. A template's diagonals are one band while each differs by at most
    ``drift`` from the next; a band's hits are one span while each begins at most ``gap`` words behind all
    before it. A span that holds at least ``coverage`` of the template's k-grams, in at most twice its words,
    adds the template's label. score: the best coverage, 1 for a phrase, else 0.

    Null text counts as empty: 0 words, no labels (empty strings), score 0. Null or repeated doc_ids
    keep their rows; equal texts are scanned alike. Empty input: no rows. Other columns are ignored.
    """
    spark, bodies = df.sparkSession, _bodies(phrases, templates)
    stage, table = Stage(spark, "licenses"), template_grams(spark, bodies)
    small = sum(len(w) for *_, w in bodies) <= FEW
    ks = sorted({min(K, len(w)) for *_, w in bodies})

    # the Kelvin sign is the one character beyond ASCII whose lower case is an ASCII letter by itself
    text = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    docs = df.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_text"), F.array_remove(F.split(text, BETWEEN), "").alias("_w"))
    word = lambda i: F.get("_w", i)
    places = F.transform("_w", lambda w, i: i)
    if small:
        starts = sorted({w[p] for *_, w in bodies for p in range(len(w) - min(K, len(w)) + 1)})
        places = F.filter(F.transform("_w", lambda w, i: F.when(w.isin(starts), i)), lambda i: i.isNotNull())
    grams = F.flatten(F.transform(places, lambda i: F.array(*[F.struct(i.alias("pos"), F.lit(k).alias("k"), _key([word(i + j) for j in range(k)]).alias("key")) for k in ks])))
    if small:
        keys = [r[0] for r in table.select("key").distinct().collect()]
        grams = F.filter(grams, lambda g: g["key"].isin(keys))
    grams = F.transform(grams, lambda g: F.struct(g["pos"].alias("pos"), g["key"].alias("key"), F.array_join(F.slice("_w", g["pos"] + 1, g["k"]), " ").alias("gram")))
    docs = stage.put(docs.select("doc_id", "_text", F.size("_w").cast("long").alias("n_words"), grams.alias("grams")))

    # equal texts hit alike: one row of them is enough
    own = docs.where(F.size("grams") > 0).select("_text", "grams").distinct().select("_text", F.inline("grams"))
    hits = own.join(F.broadcast(table) if small else table, ["key", "gram"])
    by = ["_text", "template", "label", "base", "length", "grams"]
    votes = hits.groupBy(*by, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("at").alias("ats"))
    so_far = lambda order: order.rowsBetween(W.unboundedPreceding, 0)
    across = W.partitionBy("_text", "template").orderBy("diagonal")
    votes = votes.withColumn("new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(across) > drift, F.lit(True)).cast("int"))
    votes = votes.withColumn("band", F.sum("new").over(so_far(across)))
    along = W.partitionBy("_text", "template", "band").orderBy("lo", "diagonal")
    far = F.coalesce(F.col("lo") - F.max("hi").over(along.rowsBetween(W.unboundedPreceding, -1)) > gap, F.lit(True))
    votes = votes.withColumn("new", (far | F.col("base") | (F.col("grams") == 1)).cast("int"))
    votes = votes.withColumn("span", F.sum("new").over(so_far(along)))
    spans = votes.groupBy(*by, "band", "span").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("held"))
    base, share = F.col("base"), F.col("held") / F.col("grams")
    fits = (F.col("hi") - F.col("lo") + F.least(F.col("length"), F.lit(K))) <= 2 * F.col("length")
    spans = spans.withColumn("share", share).where(base & (F.col("held") == F.col("grams")) | ~base & (share >= coverage) & fits)
    found = spans.groupBy("_text").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("lo"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("lo"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
    )
    out = spread_join(docs.select("doc_id", "_text", "n_words"), found, ["_text"], F.col("doc_id"))
    none = F.lit("")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _sql_rows() -> str:
    return ", ".join(f"({t}, '{label}', {base}, '{' '.join(words)}')" for t, label, base, words in _bodies(PHRASES, TEMPLATES))


#: DuckDB SQL for the rows of ``op4_license_scan``.
SCAN_SQL = rf"""
WITH b AS (SELECT template, label, base, string_split(body, ' ') AS w, least(len(string_split(body, ' ')), 4) AS k FROM (VALUES {_sql_rows()}) AS v(template, label, base, body)),
t AS (SELECT template, label, base, len(w) AS length, len(w) - k + 1 AS grams, k, p - 1 AS place, array_to_string(w[p : p + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM b)),
d AS (SELECT doc_id, md5(coalesce(text, '')) AS id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT id, p - 1 AS pos, k, array_to_string(w[p : p + k - 1], ' ') AS gram FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS p FROM (SELECT id, any_value(w) AS w FROM d GROUP BY id)) CROSS JOIN (SELECT DISTINCT k FROM b) WHERE p + k - 1 <= len(w)),
h AS (SELECT id, template, label, base, length, grams, pos - place AS diagonal, pos, place FROM g JOIN t USING (k, gram)),
v AS (SELECT id, template, label, base, length, grams, diagonal, list(DISTINCT place) AS places, min(pos) AS lo, max(pos) AS hi FROM h GROUP BY ALL),
b0 AS (SELECT id, template, diagonal AS band FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.id = a.id AND b.template = a.template AND b.diagonal BETWEEN a.diagonal - 3 AND a.diagonal - 1)),
n AS (SELECT v.*, band, lo * 1000000000 + diagonal AS place FROM v ASOF JOIN b0 ON v.id = b0.id AND v.template = b0.template AND v.diagonal >= b0.band),
s0 AS (SELECT id, template, band, place AS span FROM n a WHERE base OR grams = 1 OR NOT EXISTS (SELECT 1 FROM n b WHERE b.id = a.id AND b.template = a.template AND b.band = a.band AND b.place < a.place AND b.hi >= a.lo - 8)),
s AS (SELECT n.*, span FROM n ASOF JOIN s0 ON n.id = s0.id AND n.template = s0.template AND n.band = s0.band AND n.place >= s0.span),
m AS (SELECT id, template, label, base, length, grams, span, CAST(len(list_distinct(flatten(list(places)))) AS DOUBLE) / grams AS share, min(s.lo) AS lo, max(s.hi) AS hi FROM s GROUP BY id, template, label, base, length, grams, band, span),
f AS (SELECT * FROM m WHERE base AND share >= 1 OR NOT base AND share >= 0.6 AND hi - lo + least(length, 4) <= 2 * length),
r AS (SELECT id, count(*) FILTER (base) AS n_base, min(f.lo) FILTER (f.base) AS first_word, max(f.lo) FILTER (f.base) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score FROM f GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN r USING (id)
"""
