"""Training data: negatives, triplets, hard-negative groups and evaluation samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import Scratch
from .ingest import hash_order


def _pair_order(seed: int):
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col("qid").cast("string"), F.lit("|"), F.col("doc_id").cast("string")))


def _places(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, _at): every document's place from 0 in hash order; only sums of 65,536 hash ranges meet in one task."""
    d = docs.select("doc_id", hash_order(F.col("doc_id"), seed).alias("_h")).withColumn("_b", F.substring("_h", 1, 4))
    before = d.groupBy("_b").agg(F.count("*").alias("_c")).select("_b", (F.sum("_c").over(W.orderBy("_b")) - F.col("_c")).alias("_before"))
    d = d.withColumn("_n", F.row_number().over(W.partitionBy("_b").orderBy("_h", "doc_id")))
    return d.join(before, "_b").select("doc_id", (F.col("_before") + F.col("_n") - 1).alias("_at"))


def random_negatives(queries: DataFrame, docs: DataFrame, positives: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """(qid, doc_id, n): n documents of each query that are not among its positives, or all such if there are fewer.

    Drawn without replacement from all documents in hash order: each query starts at a hashed place and
    looks at 8n documents from there on; where these hold fewer than n negatives, at four times as many.
    What is drawn is written: texts are then looked up for few rows.
    """
    scratch = Scratch(docs.sparkSession, "places")
    drawn = scratch.put(_places(docs, seed))  # each round reads it
    size = max(docs.count(), 1)
    start = F.conv(F.substring(hash_order(F.col("qid"), seed), 1, 8), 16, 10).cast("long") % size
    known = positives.select("qid", "doc_id").distinct()
    pending, done, width = queries.select("qid"), None, min(size, 8 * n)
    while True:
        pairs = pending.select("qid", start.alias("_start"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_d"))
        pairs = pairs.withColumn("_at", (F.col("_start") + F.col("_d")) % size).join(drawn, "_at").join(known, ["qid", "doc_id"], "left_anti")
        got = pairs.select("qid", "doc_id", F.row_number().over(W.partitionBy("qid").orderBy("_d")).alias("n")).where(F.col("n") <= n)
        got = scratch.put(got)
        if width == size:
            return got if done is None else done.unionByName(got)
        full = got.where(F.col("n") == n).select("qid").distinct()
        short = pending.join(full, "qid", "left_anti")
        if short.isEmpty():
            return got if done is None else done.unionByName(got)
        got = got.join(full, "qid", "left_semi")
        done = got if done is None else done.unionByName(got)
        pending, width = short, min(size, 4 * width)


def one_positive(positives: DataFrame, seed: int = 42) -> DataFrame:
    """(qid, doc_id): one positive of each query, by hash."""
    return positives.groupBy("qid").agg(F.min_by("doc_id", F.struct(_pair_order(seed), "doc_id")).alias("doc_id"))


def training_records(queries: DataFrame, docs: DataFrame, qrels: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """(qid, query, positives array, negatives array) of texts in id order; without a positive text no record."""
    positives = qrels.where("rel > 0")
    texts = docs.select("doc_id", "text")
    listed = lambda d: d.join(texts, "doc_id").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda s: s["text"]).alias("t"))
    p = listed(positives.select("qid", "doc_id").distinct()).withColumnRenamed("t", "positives")
    m = listed(random_negatives(queries, docs, positives, n, seed)).withColumnRenamed("t", "negatives")
    none = F.expr("cast(array() as array<string>)")
    return queries.select("qid", "query").join(p, "qid").join(m, "qid", "left").withColumn("negatives", F.coalesce("negatives", none))


def triplets(queries: DataFrame, docs: DataFrame, qrels: DataFrame, negatives: int = 3, max_samples: int | None = None, seed: int = 42) -> DataFrame:
    """(qid, query, positive, negative), one row a negative (1 to 3 a query), the first ``max_samples`` in hash order."""
    positives = qrels.where("rel > 0").select("qid", "doc_id").distinct()
    p = one_positive(positives, seed).join(docs.select("doc_id", F.col("text").alias("positive")), "doc_id").select("qid", "positive")
    m = random_negatives(queries.join(positives, "qid", "left_semi"), docs, positives, min(max(negatives, 1), 3), seed)
    m = m.join(docs.select("doc_id", F.col("text").alias("negative")), "doc_id").select("qid", "n", "negative")
    out = queries.select("qid", "query").join(p, "qid").join(m, "qid")
    if max_samples:
        out = out.orderBy(hash_order(F.col("qid"), seed), "qid", "n").limit(max_samples)
    return out.select("qid", "query", "positive", "negative")


def quotas(n: int) -> tuple[int, int, int]:
    """How many of n negatives are hard, medium and easy."""
    hard = max(1, n // 2)
    medium = max(1, (n - hard) // 2)
    return hard, medium, n - hard - medium


def hard_negatives(run: DataFrame, qrels: DataFrame, n: int = 7, skip: int = 2, zone: tuple[int, int] = (10, 20), depth: int = 50) -> DataFrame:
    """(qid, doc_id, chunk_id, zone, pos) from a dense run (qid, chunk_id, doc_id, rank).

    Zones by rank from 0: hard from ``skip``, then medium and easy up to skip + depth; no zone fills in
    for another. Judged documents of any grade are no negatives.
    """
    at, a, b = F.col("rank") - 1, skip + zone[0], skip + zone[0] + zone[1]
    hard, medium, easy = quotas(n)
    z = run.where((at >= skip) & (at < skip + depth)).join(qrels.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_anti")
    z = z.withColumn("zone", F.when(at < a, 0).when(at < b, 1).otherwise(2))
    z = z.withColumn("_n", F.row_number().over(W.partitionBy("qid", "zone").orderBy("rank")))
    z = z.where(F.col("_n") <= F.element_at(F.array(F.lit(hard), F.lit(medium), F.lit(easy)), F.col("zone") + 1))
    return z.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).select("qid", "doc_id", "chunk_id", "zone", "pos")


def cross_encoder_groups(queries: DataFrame, negatives: DataFrame, positives: DataFrame, first_chunks: DataFrame, chunks: DataFrame, scorer=None) -> DataFrame:
    """(qid, query, docs array, labels array): the positive's first chunk, then the negatives in order.

    Labels are 1 and 0, or a teacher's scores if a scorer is given. Groups without negatives drop out.
    """
    p = positives.groupBy("qid").agg(F.min("doc_id").alias("doc_id")).join(first_chunks, "doc_id").select("qid", F.lit(0).alias("pos"), F.col("chunk_text").alias("doc"))
    m = negatives.join(chunks.select("chunk_id", F.col("chunk_text").alias("doc")), "chunk_id").select("qid", "pos", "doc")
    rows = p.unionByName(m.join(p.select("qid"), "qid", "left_semi")).join(queries.select("qid", "query"), "qid")
    label = F.round(scorer(F.col("query"), F.col("doc")), 6) if scorer else (F.col("pos") == 0).cast("double")
    rows = rows.withColumn("label", label)
    g = rows.groupBy("qid", "query").agg(F.array_sort(F.collect_list(F.struct("pos", "doc", "label"))).alias("g")).where(F.size("g") > 1)
    return g.select("qid", "query", F.transform("g", lambda s: s["doc"]).alias("docs"), F.transform("g", lambda s: s["label"]).alias("labels"))


def teacher_diagnostics(groups: DataFrame) -> DataFrame:
    """One row: mean label of positives and of negatives, share of groups whose positive beats all negatives."""
    negatives = F.slice("labels", 2, F.size("labels"))
    sums = groups.select(F.col("labels")[0].alias("p"), F.aggregate(negatives, F.lit(0.0), lambda a, x: a + x).alias("s"), F.size(negatives).alias("n"), F.array_max(negatives).alias("m"))
    return sums.agg(F.round(F.avg("p"), 6).alias("positive_mean"), F.round(F.sum("s") / F.sum("n"), 6).alias("negative_mean"), F.round(F.avg((F.col("p") > F.col("m")).cast("double")), 6).alias("wins"))


def rerank_samples(queries: DataFrame, run: DataFrame, qrels: DataFrame, first_chunks: DataFrame, n: int = 20, skip: int = 2) -> DataFrame:
    """(qid, query, positive array, negative array) of first-chunk texts; negatives from rank ``skip`` on, at most n documents."""
    positives = qrels.where("rel > 0").select("qid", "doc_id").distinct()
    texts = lambda d: d.join(first_chunks, "doc_id")
    p = texts(positives).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "chunk_text"))), lambda s: s["chunk_text"]).alias("positive"))
    m = run.where(F.col("rank") > skip).groupBy("qid", "doc_id").agg(F.min("rank").alias("rank")).join(qrels.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_anti")
    m = m.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).where(F.col("pos") <= n)
    m = texts(Scratch(run.sparkSession, "samples").put(m)).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_text"))), lambda s: s["chunk_text"]).alias("negative"))
    return queries.select("qid", "query").join(p, "qid").join(m, "qid")


def eval_sample(queries: DataFrame, docs: DataFrame, qrels: DataFrame, fraction: float = 0.1, most: int = 1000, others: int = 20_000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(queries, documents) of a retrieval check: min(most, max(1, n * fraction)) queries, their relevant documents and ``others`` more."""
    n = min(most, max(1, int(queries.count() * fraction)))
    q = queries.orderBy(hash_order(F.col("qid"), seed), "qid").limit(n)
    relevant = qrels.where("rel > 0").join(q.select("qid"), "qid", "left_semi").select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_semi")
    more = docs.select("doc_id").join(relevant, "doc_id", "left_anti").orderBy(hash_order(F.col("doc_id"), seed), "doc_id").limit(others)
    return q, relevant.unionByName(more)


#: Items whose words ``shared_runs`` may send to every task.
FEW_ITEMS = 10_000
#: Texts that a task of ``shared_runs`` looks at together.
SOME = 1000


class Runs:
    """The distinct runs of ``n`` words of some items, sorted by a hash of their words' codes, and the items that have each."""

    def __init__(self, items: list, n: int):
        import numpy as np

        terms: dict = {}
        runs: dict = {}
        for qid, words in items:
            codes = [terms.setdefault(w, len(terms)) for w in words]
            for i in range(len(codes) - n + 1):
                runs.setdefault(tuple(codes[i : i + n]), {})[qid] = None
        self.n, self.terms, self.power = n, list(terms), np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(n)], np.uint64)
        codes = np.array(list(runs), np.int64).reshape(-1, n)
        key = self.hashes(codes.reshape(-1))[::n] if len(codes) else np.empty(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.codes, owners = key[order], codes[order], list(runs.values())
        self.qids = [list(owners[i]) for i in order]

    def hashes(self, codes):
        """The hash of the run that starts at each place."""
        import numpy as np

        m = max(len(codes) - self.n + 1, 0)
        out = np.zeros(m, np.uint64)
        for i in range(self.n):
            out += (codes[i : i + m] + 1).astype(np.uint64) * self.power[i]
        return out

    def found(self, codes, ends):
        """(place, run) of the runs in texts one after the other: word codes, -1 for words of no item, and each word's text's end."""
        import numpy as np

        m = max(len(codes) - self.n + 1, 0)
        unknown = np.append(0, np.cumsum(codes < 0))
        at = np.nonzero((unknown[self.n :] == unknown[:m]) & (np.arange(m) + self.n <= ends[:m]))[0]
        own = self.hashes(codes)[at]
        first, last = np.searchsorted(self.key, own, "left"), np.searchsorted(self.key, own, "right")
        places, runs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(int((last - first).max(initial=0))):  # runs of equal hash, word by word
            some = np.nonzero(first + k < last)[0]
            some = some[(codes[at[some][:, None] + np.arange(self.n)] == self.codes[first[some] + k]).all(axis=1)]
            places.append(at[some])
            runs.append(first[some] + k)
        return np.concatenate(places), np.concatenate(runs)


def shared_runs(docs: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    """(qid, doc_id) of the items (qid, words) and the texts (doc_id, text), words between blanks, that share a run of ``n`` words.

    Items are few, at most ``FEW_ITEMS``: their runs are sent to the tasks, and texts stay where they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Runs([tuple(r) for r in items.select("qid", "words").collect()], n))
    kinds = [f"{c} {x.schema[c].dataType.simpleString()}" for x, c in ((items, "qid"), (docs, "doc_id"))]
    qid, doc_id = (pa.string() if k.endswith(" string") else pa.int64() for k in kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        runs = shared.value
        terms = pa.array(runs.terms, pa.string())
        for whole in batches:
            for a in range(0, whole.num_rows, SOME):
                b = whole.slice(a, SOME)
                words = pc.split_pattern(pc.fill_null(b.column(1), ""), " ")
                size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                codes = pc.fill_null(pc.index_in(words.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row, ends = np.repeat(np.arange(b.num_rows), size), np.repeat(np.cumsum(size), size)
                places, hits = runs.found(codes, ends)
                pairs = {(q, int(row[p])) for p, r in zip(places, hits) for q in runs.qids[r]}
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in pairs], qid), b.column(0).take(pa.array([i for _, i in pairs], pa.int64())).cast(doc_id)], ["qid", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(kinds)).distinct()
