"""Ranking metrics for all queries and cut-offs in one job."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _by_query(qrels: DataFrame, run: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Per judged qid and k: dcg, idcg, hits, ap, first (rank of the first hit), positives."""
    judged = qrels.groupBy("qid", "doc_id").agg(F.max("rel").alias("rel"))
    ideal = judged.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")))
    cut = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    gain = F.col("rel") / (F.log(F.col("rank") + 1.0) / F.log(F.lit(2.0)))
    ideal = ideal.select("*", cut).groupBy("qid", "k").agg(
        F.sum(F.when(F.col("rank") <= F.col("k"), gain)).alias("idcg"), F.count_if(F.col("rel") > 0).alias("positives")
    )
    hits = run.select("qid", F.col("doc_id").cast("string").alias("doc_id"), "rank").join(judged.withColumn("doc_id", F.col("doc_id").cast("string")), ["qid", "doc_id"]).where("rel <> 0")
    seen = F.sum((F.col("rel") > 0).cast("int")).over(W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    hits = hits.withColumn("seen", seen).select("*", cut).where(F.col("rank") <= F.col("k"))
    positive = F.col("rel") > 0
    got = hits.groupBy("qid", "k").agg(
        F.sum(gain).alias("dcg"), F.count_if(positive).alias("hits"),
        F.sum(F.when(positive, F.col("seen") / F.col("rank"))).alias("ap"), F.min(F.when(positive, F.col("rank"))).alias("first"),
    )
    return ideal.join(got, ["qid", "k"], "left").na.fill(0.0, ["dcg", "ap", "idcg"]).na.fill(0, ["hits"])


def evaluate(qrels: DataFrame, run: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10, 100), mrr_k: int = 10) -> DataFrame:
    """(metric, k, value) of a run (qid, doc_id, rank) against (qid, doc_id, rel).

    NDCG has linear gain and averages over all judged queries, as MRR does; recall, MAP and precision
    (always over k) average over queries with a positive, 0.0 if there is none. Without judged
    queries NDCG and MRR are null.
    """
    every = tuple(dict.fromkeys((*ks, mrr_k)))
    q = _by_query(qrels, run, every)
    some = F.col("positives") > 0
    zero = F.lit(0.0)
    each = q.groupBy("k").agg(
        F.avg(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(zero)).alias("NDCG"),
        F.avg(F.when(some, F.col("hits") / F.col("positives"))).alias("Recall"),
        F.avg(F.when(some, F.col("ap") / F.least(F.col("positives"), F.col("k")))).alias("MAP"),
        F.avg(F.when(some, F.col("hits") / F.col("k"))).alias("Precision"),
        F.avg(F.coalesce(1.0 / F.col("first"), zero)).alias("MRR"),
    )
    cuts = qrels.sparkSession.createDataFrame([(k,) for k in every], "k int")
    each = cuts.join(each, "k", "left").na.fill(0.0, ["Recall", "MAP", "Precision"])
    names = ("NDCG", "Recall", "MAP", "Precision", "MRR")
    rows = each.select("k", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")).select("m.metric", "k", F.round("m.value", 6).alias("value"))
    return rows.where((F.col("metric") == "MRR") & (F.col("k") == mrr_k) | (F.col("metric") != "MRR") & F.col("k").isin(*ks))


def compare_runs(runs: DataFrame, model: str, total: str, retrieval: str) -> DataFrame:
    """(model, runs, avg_total_s, avg_retrieval_s) of timed runs; a run without a time counts in runs alone."""
    return runs.groupBy(F.col(model).alias("model")).agg(F.count("*").alias("runs"), F.round(F.avg(total), 6).alias("avg_total_s"), F.round(F.avg(retrieval), 6).alias("avg_retrieval_s"))


#: Documents of a group that one block of pairs takes from either side.
TILE = 2048


def lambda_loss(groups: DataFrame) -> DataFrame:
    """(group, loss) over (group, pos from 1, score, label).

    The mean over pairs with label_i > label_j of log(1 + exp(s_j - s_i)) times the change of NDCG by a
    swap, where a document's discount follows its position in the list, not its score.

    Pairs are never rows: a group is cut into tiles of ``TILE`` documents by position, each two tiles are one
    row, whose pairs are summed up at once. A long list is as many tasks' work as it has tiles.
    """
    disc = 1.0 / (F.log(F.col("pos") + 1.0) / F.log(F.lit(2.0)))
    g = groups.withColumn("disc", disc)
    ideal = g.withColumn("r", F.row_number().over(W.partitionBy("group").orderBy(F.desc("label")))).groupBy("group").agg(
        F.greatest(F.sum(F.col("label") / (F.log(F.col("r") + 1.0) / F.log(F.lit(2.0)))), F.lit(1e-10)).alias("idcg")
    )
    each = lambda c: F.col(c).cast("double").alias(c)
    tiles = g.groupBy("group", F.floor((F.col("pos") - 1) / TILE).alias("tile")).agg(F.collect_list(F.struct(each("score"), each("label"), each("disc"))).alias("t"))
    side = lambda name: tiles.select("group", *[F.col(f"t.{c}").alias(f"{name}_{c}") for c in ("score", "label", "disc")])
    blocks = side("a").join(side("b"), "group")
    kind = groups.schema["group"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            total, n = [], []
            for row in zip(*b.columns[1:]):
                s, y, d, s2, y2, d2 = (x.values.to_numpy(zero_copy_only=False) for x in row)
                i, j = np.nonzero(y[:, None] > y2[None, :])
                total.append(float((np.log1p(np.exp(s2[j] - s[i])) * np.abs(d[i] - d2[j]) * (y[i] - y2[j])).sum()))
                n.append(len(i))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.float64()), pa.array(n, pa.int64())], ["group", "total", "n"])

    got = blocks.mapInArrow(sums, f"group {kind}, total double, n long").groupBy("group").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"))
    return ideal.join(got, "group", "left").select("group", F.round(F.coalesce(F.col("mean") / F.col("idcg"), F.lit(0.0)), 6).alias("loss"))
