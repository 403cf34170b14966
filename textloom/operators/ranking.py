"""Top-k windows; rank is a column, ties go to the smaller id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import Scratch


def ranked(df: DataFrame, keys: list[str], item: str = "chunk_id", score: str = "score") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), item)))


def top_k(df: DataFrame, keys: list[str], k: int | None, item: str = "chunk_id", score: str = "score") -> DataFrame:
    """Ranks and, for a truthy k, the first k; Spark limits groups before the shuffle."""
    out = ranked(df, keys, item, score)
    return out.where(F.col("rank") <= k) if k else out


#: Rows whose keys ``looked_up`` sends to the table; beyond it Spark picks the join.
FEW = 200_000


def looked_up(results: DataFrame, table: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """results, written, and the rows of table that they name: where results are few, none of the table's rows is shuffled."""
    own = Scratch(results.sparkSession, "results").put(results)
    keys = own.select(key).distinct()
    return own, table.join(F.broadcast(keys) if own.count() <= FEW else keys, key, "left_semi")


class Best:
    """The ``k`` best items of each of ``n`` queries that a task has seen so far; scores are rounded to six digits, ties go to the smaller id.

    ``limit`` is each query's k-th score: what lies below it needs no look. New items are sorted in when
    they are many, so at most about ``room`` of them wait beside the lists.
    """

    def __init__(self, n: int, k: int, room: int = 200_000):
        import numpy as np

        self.k, self.room, self.limit = k, max(room, n * k), np.full(n, -np.inf)
        self.query, self.item, self.score, self.fresh = np.empty(0, np.int64), np.empty(0, object), np.empty(0), 0

    def add(self, scores, ids: Callable, held=None) -> None:
        """scores: a matrix of queries and items; ids(i): the names of items i; held: which cells count, if not all."""
        import numpy as np

        counted = scores if held is None else np.where(held, scores, -np.inf)
        if scores.shape[1] > self.k:
            self.limit = np.maximum(self.limit, np.round(np.partition(counted, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k], 6))
        q, i = np.nonzero((counted >= self.limit[:, None] - 1e-6) & (counted > -np.inf))
        own = np.round(scores[q, i], 6)
        keep = own >= self.limit[q]
        q, i, own = q[keep], i[keep], own[keep]
        self.query, self.item, self.score = np.concatenate((self.query, q)), np.concatenate((self.item, ids(i))), np.concatenate((self.score, own))
        self.fresh += len(q)
        if self.fresh > self.room:
            self.lists()

    def lists(self):
        """(query, item, score), ``k`` rows a query at most."""
        import numpy as np

        order = np.lexsort((np.unique(self.item, return_inverse=True)[1], -self.score, self.query)) if len(self.item) else np.empty(0, np.int64)
        place = np.arange(len(order)) - np.searchsorted(self.query[order], self.query[order])
        order, place = order[place < self.k], place[place < self.k]
        self.query, self.item, self.score, self.fresh = self.query[order], self.item[order], self.score[order], 0
        full = place == self.k - 1
        self.limit[self.query[full]] = np.maximum(self.limit[self.query[full]], self.score[full])
        return self.query, self.item, self.score
