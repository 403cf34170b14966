"""Fill-in-middle transformation of training texts. DataFrame functions only.

A text is cut into units by regexp_extract_all; digits of a sha2 of the id say where prefix and middle
end and which form the text takes. slice and array_join build the parts, sentinels mark them, and the
sentinels alone are enough to put the text together again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit: one code point, line ends included.
CODE_POINT = "(?s)."
#: What marks prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels between which no text can make another one: none lies within or overlaps another, or itself."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or (i != j and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (i != j))):
                raise ValueError(f"sentinels must be distinct and must not overlap: {sentinels}")
    return sentinels


def draws(doc_id: Column, seed: str = "1", n: int = 4) -> list[Column]:
    """The first ``n`` groups of eight hex digits of sha2(seed:id), as numbers; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def fill_in_middle(df: DataFrame, seed: str = "1", plain_from: int = 90, spm_below: int = 20, unit: str = CODE_POINT, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for every row of (doc_id, text).

    Prefix and middle end after two places drawn from 0 to n. psm is prefix, suffix, middle, each after
    its sentinel; spm is suffix, prefix, middle. plain, the text itself: ``100 - plain_from`` per cent of
    the texts, empty ones, those that hold a sentinel, and those that ``unit`` doesn't cover without a gap.
    ``spm_below`` per cent of the others are spm. prefix_chars and middle_chars count code points, null if plain.

    Null text counts as empty. Null doc_id: the draw of an empty id. Rows with equal ids draw alike and
    are kept each. Empty input: no rows. Other columns are ignored. A task holds the units of one text at a time.
    """
    p, s, m = _checked(sentinels)
    h = F.col("_h")
    d = df.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), F.array(*draws(F.col("doc_id"), seed)).alias("_h"))
    d = d.withColumn("_units", F.regexp_extract_all("_text", F.lit(unit), 0))
    n = F.size("_units")
    spots = [F.pmod(h[i], (n + 1).cast("long")).cast("int") for i in (0, 1)]
    covered = F.lit(True) if unit == CODE_POINT else F.array_join("_units", "") == F.col("_text")
    plain = (n == 0) | F.rlike("_text", F.lit("|".join(map(re.escape, sentinels)))) | (F.pmod(h[2], F.lit(100)) >= plain_from) | ~covered
    form = F.when(plain, "plain").when(F.pmod(h[3], F.lit(100)) < spm_below, "spm").otherwise("psm")
    d = d.select("doc_id", "_text", "_units", n.cast("long").alias("n"), F.least(*spots).alias("_a"), F.greatest(*spots).alias("_b"), form.alias("form"))
    # parts of plain texts are never built
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("_units", start, length), ""))
    a, b = F.col("_a"), F.col("_b")
    d = d.select("doc_id", "n", "form", "_text", part(F.lit(1), a).alias("_prefix"), part(a + 1, b - a).alias("_middle"), part(b + 1, n - b).alias("_suffix"))
    prefix, suffix, middle = (F.concat(F.lit(mark), F.col(name)) for mark, name in ((p, "_prefix"), (s, "_suffix"), (m, "_middle")))
    output = F.when(F.col("form") == "psm", F.concat(prefix, suffix, middle)).when(F.col("form") == "spm", F.concat(suffix, prefix, middle)).otherwise(F.col("_text"))
    return d.select("doc_id", "n", "form", F.char_length("_prefix").cast("long").alias("prefix_chars"), F.char_length("_middle").cast("long").alias("middle_chars"), output.alias("output"))


def restored(df: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """df, with columns (output, form), and ``restored``: the text that they stand for, cut at the sentinels and put back in order."""
    marks, c = "|".join(map(re.escape, _checked(sentinels))), F.col("_cut")
    d = df.withColumn("_cut", F.when(F.col("form") != "plain", F.split("output", marks)))
    text = F.when(F.col("form") == "psm", F.concat(c[1], c[3], c[2])).when(F.col("form") == "spm", F.concat(c[2], c[3], c[1])).otherwise(F.col("output"))
    return d.withColumn("restored", text).drop("_cut")


#: DuckDB SQL for the rows of ``op11_fill_in_middle``.
FIM_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT doc_id, t, n, [CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT) FOR i IN [0, 1, 2, 3]] AS h FROM d),
c AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
  ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END AS o FROM c),
k AS (SELECT *, strpos(o, '<P>') AS p, strpos(o, '<S>') AS s, strpos(o, '<M>') AS m FROM o),
r AS (SELECT *, CASE form WHEN 'plain' THEN o WHEN 'psm' THEN substring(o, p + 3, s - p - 3) || substring(o, m + 3) || substring(o, s + 3, m - s - 3)
  ELSE substring(o, p + 3, m - p - 3) || substring(o, m + 3) || substring(o, s + 3, p - s - 3) END AS back FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN a END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN b - a END AS BIGINT) AS middle_chars,
  sha256(o) AS output_sha256, sha256(back) AS restored_sha256 FROM r
"""
