"""Mixing sources to target weights by a time-varying curriculum. DataFrame functions only.

Each source has a weight schedule over training time t in [0, 1]. The schedule's integral is the
source's demand in words; a document's place in its source's cumulative supply is inverted through
the integrated schedule into a training position, and the stream is range-sorted by position.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Stage

WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=(1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share all words; a target
    stops at ``cap`` times its source's size and the excess is shared anew by weight. Closed form of
    that loop: in the order of cap/weight, a source is capped as long as its cap is not above its
    share of what the capped ones before it leave.
    """
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    t = t.withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    order = W.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    t = t.withColumn("_left", F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("_level", F.col("_left") / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    t = t.withColumn("_capped", F.col("_cap") / F.col("weight") <= F.col("_level"))
    level = F.max(F.when(~F.col("_capped"), F.col("_level"))).over(W.partitionBy())
    return t.withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(level * F.col("weight"))).select("source", "source_size", "weight", "target")


def demand(t, tilt, target):
    """Words that a source gives by time t: the integral of target * (1 + tilt * (1 - 2t))."""
    return target * ((1 + tilt) * t - tilt * t * t)


def _time_of(words, tilt, target):
    """The time by which the demand reaches ``words``: its inverse, in the form without cancellation."""
    x = words / F.nullif(target, F.lit(0.0))  # no target, nothing taken
    return (2 * x) / ((1 + tilt) + F.sqrt(F.greatest((1 + tilt) * (1 + tilt) - 4 * tilt * x, F.lit(0.0))))


def mix(df: DataFrame, weights=(1, 2, 3), cap: float = 3.0, tilts=(0.5, 0.0, -0.5), bucket_digits: int = 3) -> DataFrame:
    """Assign every document its training positions and the words that the mix takes there.

    Returns doc_id, source, size, source_size, target, taken, positions (0 to 1, ascending: one for each
    time the document starts; empty if nothing is taken) and position (the first; else null),
    range-sorted by position. ``training_stream`` gives a row for each start.

    ``tilts``: a source of the i-th weight is drawn at the rate target * (1 + tilt * (1 - 2t)), tilt from
    -1 to 1. Its documents follow md5(doc_id), pass after pass; a start whose predecessors hold c words
    takes place when the integrated rate reaches c, and takes what the demand still leaves at the end
    of training, its whole size at most. So each source takes exactly its rounded target, the last
    start cut within its document.

    Cumulative sizes are built in two levels (hash prefixes of ``bucket_digits`` hex digits, then rows
    within a prefix), so that no task holds a whole source unless its rows share one doc_id.

    Null or empty text: size 0, nothing taken. Null source: a source of its own, last in order. Null
    doc_id: ordered as empty text. Repeated rows are mixed as rows of their own; rows that tie in
    doc_id and size share interchangeable results. Empty input: no rows. Other columns are ignored.
    """
    stage = Stage(df.sparkSession, "mix")
    rows = stage.put(df.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("_key"),
    ))
    targets = source_targets(rows, weights, cap)
    rows = rows.withColumn("_bucket", F.substring("_key", 1, bucket_digits))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("source", "_bucket", before.alias("_before"))
    s, b = targets.alias("t"), sums.alias("b")
    sums = b.join(s, F.expr("t.source <=> b.source")).select("b.source", "b._bucket", "b._before", "t.source_size", "t.weight", "t.target")
    inner = F.sum("size").over(W.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    # a numbered null keeps both sides of the join hashed on plain keys
    named = lambda d: d.withColumn("_null", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit("")))
    r = named(rows.withColumn("_end", inner))
    m = named(sums).drop("source")
    x = r.join(m, ["_source", "_null", "_bucket"])
    tilt = F.element_at(F.array(*[F.lit(float(t)) for t in tilts]), F.array_position(F.array(*[F.lit(int(w)) for w in weights]), F.col("weight")).cast("int"))
    x = x.withColumn("_start", F.col("_before") + F.col("_end") - F.col("size")).withColumn("_tilt", tilt).withColumn("_all", F.round("target").cast("long"))
    passes = F.transform(F.sequence(F.lit(0), F.lit(max(math.ceil(cap) - 1, 0))), lambda p: p * F.col("source_size") + F.col("_start"))
    starts = F.filter(F.transform(passes, lambda c: F.struct(_time_of(c, F.col("_tilt"), F.col("target")).alias("t"), F.least(F.col("size"), F.col("_all") - c).alias("n"))), lambda x: x["n"] > 0)
    x = x.withColumn("_starts", starts).withColumn("positions", F.col("_starts.t")).withColumn("position", F.get("positions", F.lit(0)))
    x = x.withColumn("taken", F.aggregate("_starts", F.lit(0).cast("long"), lambda n, x: n + x["n"]))
    return x.select("doc_id", "source", "size", "source_size", "target", "taken", "positions", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_stream(mixed: DataFrame) -> DataFrame:
    """(doc_id, source, pass, position, words): a row for each start in ``mix``'s result, range-sorted by position."""
    rows = mixed.select("doc_id", "source", "size", "taken", F.posexplode("positions").alias("pass", "position"))
    words = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    return rows.select("doc_id", "source", "pass", "position", words.alias("words")).orderBy("position", "doc_id")


#: DuckDB SQL for the rows of ``op10_mixing``.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / CAST(sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM c),
t AS (
  SELECT source, source_size, weight,
         CASE WHEN cap / weight <= level THEN cap
              ELSE max(CASE WHEN cap / weight > level THEN level END) OVER () * weight END AS target
  FROM l),
x AS (
  SELECT d.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS demand, CAST(CASE t.weight WHEN 1 THEN 0.5 WHEN 2 THEN 0 ELSE -0.5 END AS DOUBLE) AS tilt,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (
  SELECT *, unnest([0, 1, 2]) AS p FROM x),
z AS (
  SELECT *, greatest(least(size, demand - p * source_size - start), 0) AS n, CAST(p * source_size + start AS DOUBLE) / target AS part FROM y),
q AS (
  SELECT *, CASE WHEN n > 0 THEN (2 * part) / ((1 + tilt) + sqrt(greatest((1 + tilt) * (1 + tilt) - 4 * tilt * part, CAST(0 AS DOUBLE)))) END AS moment FROM z)
SELECT doc_id, size, source_size, target, CAST(sum(n) AS BIGINT) AS taken, coalesce(list(moment ORDER BY p) FILTER (n > 0), CAST([] AS DOUBLE[])) AS positions, min(moment) AS position
FROM q GROUP BY k, doc_id, source, size, source_size, target, start
"""
