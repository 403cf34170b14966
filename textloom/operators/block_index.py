"""BM25 by block maxima: the same lists as a full search, from a part of the postings.

Chunks that have a word in common (the one with the smallest hash) are neighbours in an order, which is
cut into zones of a few chunks. A block holds a term's postings within a zone and their largest impact.
A query's bound for a zone is the sum of its terms' largest impacts there: no chunk of the zone scores
higher. The zones with the largest bounds are scored first; the k-th score found there is the query's
threshold, and only zones whose bound reaches the threshold of a query are read. All that ends up in a
list is scored in full, so the lists are exact.

Bounds and scores are worked out zone by zone and chunk by chunk for a whole block of queries, as in
``bm25``; no row of a query and a zone is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.scratch import Scratch
from .bm25 import FOUND, SLAB, Bm25Index, grouped, score_rows, searched, term_frequencies
from .ranking import Best, top_k

#: Scores are rounded to six digits before they are ranked; a bound must lie below a threshold by more than that.
SLACK = 1e-5


def zones(postings: DataFrame, size: int) -> DataFrame:
    """(chunk_id, zone): chunks in order of the smallest hash among their terms, ``size`` to a zone.

    Places come from counts by the hash's first 16 bits, and windows within these; chunks that share a
    hash, however many, are dealt over 64 ranges by a hash of their ids. Only sums meet in one task, at most
    65,536 times 64 of them at any size.
    """
    least = postings.groupBy("chunk_id").agg(F.min(F.xxhash64("term")).alias("h"))
    least = least.withColumn("p", F.struct(F.shiftright("h", 48).alias("a"), F.pmod(F.xxhash64("chunk_id"), F.lit(64)).alias("b")))
    sizes = least.groupBy("p").agg(F.count("*").alias("c"))
    before = sizes.select("p", (F.sum("c").over(W.orderBy("p")) - F.col("c")).alias("before"))
    place = F.col("before") + F.row_number().over(W.partitionBy("p").orderBy("h", "chunk_id")) - 1
    return least.join(before, "p").select("chunk_id", F.floor(place / size).cast("long").alias("zone"))


def _slabs(weights, t: pa.Table, starts, columns: tuple[int, ...]):
    """(first group, matrices of terms and groups, one a column) of a table of groups (group, code, ...)."""
    import numpy as np

    code, place = t.column(1).to_numpy().astype(np.int64), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
    values, step = [t.column(c).to_numpy().astype(float) for c in columns], max(1, SLAB // max(1, len(weights.terms)))
    for a in range(0, len(starts), step):
        m = min(step, len(starts) - a)
        i, j = np.searchsorted(place, (a, a + m))
        yield a, [np.bincount(code[i:j] * m + place[i:j] - a, weights=v[i:j], minlength=len(weights.terms) * m).reshape(-1, m) for v in values]


def _bounds(shared, k: int):
    """The zones of the largest bounds, from rows (zone, code, top), a zone's one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        weights = shared.value
        best, used = Best(len(weights.lists), k), weights.used()
        for t, starts in grouped(batches):
            zone = t.column(0).to_numpy()[starts]
            for a, (top, held) in _slabs(weights, t, starts, (2, 3)):
                best.add(weights.matrix @ top, lambda i, a=a: zone[a + i].astype(object), used @ (held > 0) > 0)
        query, item, score = best.lists()
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(item.tolist(), pa.int64()), pa.array(score, pa.float64())], ["q", "zone", "score"])

    return run


def _wanted(shared, more):
    """(zone, postings, scanned) from rows (zone, code, top, n): postings of all lists' terms, and of the lists that read the zone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        weights, (floor, first) = shared.value, more.value
        used = weights.used()
        for t, starts in grouped(batches):
            zone = t.column(0).to_numpy()[starts]
            out = [np.zeros(len(zone), np.int64) for _ in range(2)]
            for a, (top, n) in _slabs(weights, t, starts, (2, 3)):
                each, read = used @ n, weights.matrix @ top >= floor[:, None]
                for i, z in enumerate(zone[a : a + top.shape[1]].tolist()):
                    read[first.get(z, []), i] = True
                out[0][a : a + top.shape[1]], out[1][a : a + top.shape[1]] = each.sum(0).round(), (each * read).sum(0).round()
            yield pa.RecordBatch.from_arrays([pa.array(zone, pa.int64()), *map(pa.array, out)], ["zone", "postings", "scanned"])

    return run


@dataclass
class BlockIndex:
    """blocks (term, zone, top, n, postings array of (chunk_id, impact)), terms (term, idf); a posting counts its impact times the term's idf."""

    blocks: DataFrame
    zone: int
    terms: DataFrame

    @classmethod
    def blocks_of(cls, index: Bm25Index, zone: int = 4, parts: int | None = None) -> DataFrame:
        """A zone's chunks are brought into one task before their words are counted, so blocks are put together where they are."""
        s = index.settings
        norm = s.k1 * (1 - s.b + s.b * F.col("dl") / F.lit(index.avgdl or 1.0))
        impact = F.col("tf") * (s.k1 + 1) / (F.col("tf") + norm)
        parts = parts or int(index.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        places = zones(index.postings, zone)
        if index.chunks is None:
            p = index.postings.join(places, "chunk_id").repartition(parts, "zone")
        else:
            p = term_frequencies(index.chunks.join(places, "chunk_id").repartition(parts, "zone"), ("zone",))
        p = p.select("term", "zone", "chunk_id", impact.alias("impact"))
        return p.groupBy("term", "zone").agg(F.max("impact").alias("top"), F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("chunk_id", "impact"))).alias("postings"))

    @classmethod
    def fit(cls, index: Bm25Index, path: str, zone: int = 4, parts: int | None = None) -> BlockIndex:
        """The blocks of an index, written to ``path``, the zones of a part sorted by term: bounds read no postings."""
        write = lambda df: df.write.mode("overwrite").option("compression", "zstd")
        write(cls.blocks_of(index, zone, parts).sortWithinPartitions("term", "zone")).parquet(f"{path}/blocks")
        write(index.terms.select("term", "idf")).parquet(f"{path}/terms")
        return cls.load(index.postings.sparkSession, path, zone)

    @classmethod
    def load(cls, spark: SparkSession, path: str, zone: int = 4) -> BlockIndex:
        return cls(spark.read.parquet(f"{path}/blocks"), zone, spark.read.parquet(f"{path}/terms"))

    def _by_zone(self, codes: DataFrame) -> DataFrame:
        """(zone, code, top, n) of a block's terms, a zone's rows one after the other."""
        own = self.blocks.select("term", "zone", "top", "n").join(F.broadcast(codes), "term").select("zone", "code", "top", "n")
        return own.repartition("zone").sortWithinPartitions("zone")

    def _scores(self, shared, k: int, codes: DataFrame, zones: DataFrame) -> DataFrame:
        """Rows of ``FOUND`` from the blocks of some zones; every chunk there is scored in full."""
        own = self.blocks.select("term", "zone", "postings").join(F.broadcast(codes), "term").join(zones, "zone", "left_semi")
        own = own.select("code", F.inline("postings")).select("chunk_id", "code", "impact")
        return own.repartition("chunk_id").sortWithinPartitions("chunk_id").mapInArrow(score_rows(shared, k), FOUND)

    def _read(self, shared, k: int, codes: DataFrame, scratch: Scratch) -> DataFrame:
        """(zone, postings, scanned) for a block of queries."""
        import numpy as np

        spark, lists = self.blocks.sparkSession, len(shared.value.lists)
        # twice the zones that k chunks fill: more than k of their chunks hold a term of the query
        most = 2 * -(-k // self.zone)
        bounds = self._by_zone(codes).mapInArrow(_bounds(shared, most), "q int, zone long, score double")
        first = scratch.put(top_k(bounds, ["q"], most, item="zone").select("q", "zone"))
        scored = top_k(self._scores(shared, k, codes, first.select("zone").distinct()), ["q"], k)
        floor, early = np.full(lists, -np.inf), {}
        for q, n, least in scored.groupBy("q").agg(F.count("*"), F.min("score")).collect():
            floor[q] = least - SLACK if n >= k else -np.inf
        for q, z in first.collect():
            early.setdefault(z, []).append(q)
        return scratch.put(self._by_zone(codes).mapInArrow(_wanted(shared, spark.sparkContext.broadcast((floor, early))), "zone long, postings long, scanned long"))

    def search(self, queries: DataFrame, k: int = 100, keys: list[str] | None = None) -> DataFrame:
        """(keys, chunk_id, score, rank) of the k best chunks, as ``Bm25Index.search`` returns them."""
        scratch = Scratch(self.blocks.sparkSession, "zones")

        def found(shared, k: int, codes: DataFrame) -> DataFrame:
            read = self._read(shared, k, codes, scratch).where("scanned > 0")
            return self._scores(shared, k, codes, read.select("zone"))

        return searched(queries, self.terms, k, keys or ["qid"], found)

    def scanned(self, queries: DataFrame, k: int = 100, keys: list[str] | None = None) -> DataFrame:
        """One row: postings of the queries' terms, and how many of them lie in zones that their query's threshold or first look asks for."""
        spark = self.blocks.sparkSession
        scratch, parts = Scratch(spark, "zones"), []

        def found(shared, k: int, codes: DataFrame) -> DataFrame:
            parts.append(self._read(shared, k, codes, scratch))
            return spark.createDataFrame([], FOUND)

        searched(queries, self.terms, k, keys or ["qid"], found)
        every = spark.createDataFrame([(0, 0)], "postings long, scanned long")
        for p in parts:
            every = every.unionByName(p.select("postings", "scanned"))
        return every.agg(F.sum("postings").alias("postings"), F.sum("scanned").alias("scanned"))
