"""Corpus preparation: filters, deduplication, strata, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T


def length_filter(docs: DataFrame, low: int = 10, high: int = 10_000) -> DataFrame:
    """Documents of ``low`` to ``high`` words, with n_words.

    The count is generated, so that a text is cut into words once: a plain column is worked out again for each
    bound of the filter and for the result.
    """
    return docs.withColumn("n_words", F.explode(F.array(T.word_count(F.col("text"))))).where(F.col("n_words").between(low, high))


def with_id(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.coalesce(F.col(column), F.lit("")) != "")


def dedup_content(docs: DataFrame, order: list[str]) -> DataFrame:
    """The first document of each cleaned text, in ascending order of these columns, then of doc_id.

    Minima by hash are summed up before the shuffle, so that a text which a third of all documents hold is
    one row a task. Only hashes and ids are shuffled; texts meet the survivors in a join.
    """
    columns = [*order, *(["doc_id"] if "doc_id" not in order else [])]
    first = docs.select(T.content_hash(F.col("text")).alias("_hash"), F.struct(*columns).alias("_o")).groupBy("_hash").agg(F.min("_o").alias("_o"))
    return docs.join(first.select(F.col("_o.doc_id").alias("doc_id")), "doc_id", "left_semi")


def ingest(docs: DataFrame, low: int = 10, high: int = 10_000) -> DataFrame:
    """Length filter, then content dedup; the smallest doc_id of equal texts stays."""
    return dedup_content(length_filter(with_id(docs, "doc_id"), low, high), ["doc_id"])


def ingest_counters(docs: DataFrame, low: int = 10, high: int = 10_000) -> DataFrame:
    """One row: documents, outliers by length, duplicates among the others, kept."""
    d = docs.select(T.word_count(F.col("text")).between(low, high).alias("fits"), T.content_hash(F.col("text")).alias("h"))
    by = d.groupBy("fits", "h").agg(F.count("*").alias("n"))
    return by.agg(
        F.sum("n").alias("documents"), F.coalesce(F.sum(F.when(~F.col("fits"), F.col("n"))), F.lit(0)).alias("outliers"),
        F.coalesce(F.sum(F.when(F.col("fits"), F.col("n") - 1)), F.lit(0)).alias("duplicates"), F.count_if("fits").alias("kept"),
    )


#: Ranges into which a selection cuts the values, and distinct values that it counts one by one.
RANGES, FEW_VALUES = 4096, 50_000


def cut_points(df: DataFrame, value: str, parts: int = 3) -> list:
    """Of the n sorted numbers, those at index n*i div parts for i below ``parts``; nulls don't count, NaN is the largest.

    By selection: rows are counted by equal ranges of values, and only the ranges that hold a cut are looked
    at again, in ranges of their own, until few distinct values are left. Nothing is sorted but these, and
    nothing but ``RANGES`` or ``FEW_VALUES`` counts reaches the driver.
    """
    d = df.select(F.col(value).alias("v")).where("v is not null")
    n, kinds = d.agg(F.count("*"), F.approx_count_distinct("v")).first()
    found = _selected(d, [n * i // parts for i in range(1, parts)], kinds) if n else {}
    return [found[n * i // parts] for i in range(1, parts)] if n else []


def _selected(d: DataFrame, spots: list[int], kinds: int) -> dict:
    """Index -> value for some indexes of the sorted ``v``, of which about ``kinds`` are distinct."""
    out: dict = {}
    if kinds > FEW_VALUES:
        x = F.least(F.greatest(F.col("v").cast("double"), F.lit(-1e308)), F.lit(1e308)) / 4  # as v grows, never falls
        lo, hi = d.agg(F.min(x), F.max(x)).first()
        if lo < hi:
            bucket = F.least(F.floor((x - lo) / (hi - lo) * RANGES), F.lit(RANGES - 1))
            before, counted = 0, d.groupBy(bucket.alias("b")).agg(F.count("*").alias("c"), F.approx_count_distinct("v").alias("k")).orderBy("b").collect()
            for r in counted:
                if own := [s - before for s in spots if before <= s < before + r.c]:
                    out |= {s + before: v for s, v in _selected(d.where(bucket == r.b), own, r.k).items()}
                before += r.c
            return out
    # few values, or more than doubles tell apart, which are read in order without being held
    before, left = 0, sorted(set(spots))
    for r in d.groupBy("v").agg(F.count("*").alias("c")).orderBy("v").toLocalIterator():
        while left and left[0] < before + r.c:
            out[left.pop(0)] = r.v
        before += r.c
    return out


def bin_of(value: Column, cuts: list) -> Column:
    """Index of the first cut that is not below the value, else their number."""
    return F.coalesce(*[F.when(value <= F.lit(c), F.lit(i)) for i, c in enumerate(cuts)], F.lit(len(cuts)))


def binned(df: DataFrame, value: str, name: str, parts: int = 3) -> DataFrame:
    """df with the bin of ``value`` by its own cut points."""
    return df.withColumn(name, bin_of(F.col(value), cut_points(df, value, parts)))


def histogram(df: DataFrame, value: str, parts: int = 3) -> DataFrame:
    return binned(df, value, "bin", parts).groupBy("bin").agg(F.count("*").alias("n"))


def query_features(queries: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """qid, num_qrels (all of them) and avg_rel_len (mean n_words of judged documents in the corpus; 0 without)."""
    known = qrels.join(corpus.select("doc_id", "n_words"), "doc_id", "left")
    by = known.groupBy("qid").agg(F.count("*").alias("num_qrels"), F.avg("n_words").alias("avg_rel_len"))
    got = queries.select("qid").join(by, "qid", "left")
    return got.select("qid", F.coalesce("num_qrels", F.lit(0)).alias("num_qrels"), F.coalesce("avg_rel_len", F.lit(0.0)).alias("avg_rel_len"))


def hash_order(key: Column, seed: int = 42) -> Column:
    """A reproducible random order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def hash_ranked(df: DataFrame, key: str, strata: list[str], seed: int = 42) -> DataFrame:
    """df with ``_n``, each row's place from 1 in hash order within its stratum, and ``_all``, the stratum's rows.

    From counts by hash prefix and windows within prefixes: no task sorts a whole stratum. Strata are few,
    at most 4096 counts each, and not null.
    """
    d = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_p", F.substring("_h", 1, 3))
    sizes = d.groupBy(*strata, "_p").agg(F.count("*").alias("_c"))
    up_to = F.sum("_c").over(W.partitionBy(*strata).orderBy("_p").rowsBetween(W.unboundedPreceding, 0))
    sizes = sizes.select(*strata, "_p", (up_to - F.col("_c")).alias("_before"), F.sum("_c").over(W.partitionBy(*strata)).alias("_all"))
    d = d.join(sizes, [*strata, "_p"])
    rank = F.col("_before") + F.row_number().over(W.partitionBy(*strata, "_p").orderBy("_h", key))
    return d.withColumn("_n", rank).drop("_h", "_p", "_before")


def sample_strata(df: DataFrame, key: str, strata: list[str], ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """ceil(n * ratio) rows of each stratum, in hash order."""
    return hash_ranked(df, key, strata, seed).where(F.col("_n") <= F.ceil(F.col("_all") * ratio)).select(*df.columns)


def stratified_sample(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, ratio: float = 0.5, seed: int = 42, keep=DataFrame.persist) -> tuple[DataFrame, DataFrame]:
    """(sampled queries (qid), sampled documents (doc_id)).

    ``keep`` holds ids and numbers of the inputs, which several jobs read; the caller lets go of them when
    the result has been used.

    Queries by tertile of num_qrels and of avg_rel_len; all their known relevant documents stay; if
    those are fewer than ceil(N * ratio), each length bin is topped up to its own share.
    """
    corpus, qrels = keep(corpus.select("doc_id", "n_words")), keep(qrels)
    features = keep(query_features(queries, qrels, corpus))
    features = binned(binned(features, "num_qrels", "_a"), "avg_rel_len", "_b")
    picked = sample_strata(features, "qid", ["_a", "_b"], ratio, seed).select("qid")
    docs = binned(corpus.select("doc_id", "n_words"), "n_words", "_bin")
    related = qrels.join(picked, "qid", "left_semi").select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_semi")
    total, kept = docs.count(), related.count()
    if -(-total * ratio // 1) <= kept:
        return picked, related
    sizes = docs.groupBy("_bin").agg(F.ceil(F.count("*") * ratio).alias("_want"))
    have = docs.join(related, "doc_id", "left_semi").groupBy("_bin").agg(F.count("*").alias("_have"))
    rest = docs.join(related, "doc_id", "left_anti")
    rest = hash_ranked(rest, "doc_id", ["_bin"], seed)
    rest = rest.join(F.broadcast(sizes.join(have, "_bin", "left")), "_bin").where(F.col("_n") <= F.col("_want") - F.coalesce("_have", F.lit(0)))
    return picked, related.unionByName(rest.select("doc_id"))


def split(queries: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """queries with ``split``: floor(n * train) train, floor(n * val) val, the rest test, in hash order."""
    q, rank = hash_ranked(queries, "qid", [], seed), F.col("_n")
    a, b = F.floor(F.col("_all") * train), F.floor(F.col("_all") * val)
    return q.withColumn("split", F.when(rank <= a, "train").when(rank <= a + b, "val").otherwise("test")).select(*queries.columns, "split")


def restrict(qrels: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """The judgments whose query and document are both kept."""
    return qrels.join(queries.select("qid"), "qid", "left_semi").join(docs.select("doc_id"), "doc_id", "left_semi")


def capped(df: DataFrame, n: int, order: list) -> DataFrame:
    """The first n rows in a total order."""
    return df.orderBy(*order).limit(n)
