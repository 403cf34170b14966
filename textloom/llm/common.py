"""What the operators of this subpackage share: staging in the shared folder and connected components."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters; every lower-casing of this subpackage's contracts touches only these.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_FALLBACK = f"/tmp/checkpoints/textloom-{uuid.uuid4().hex[:12]}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a folder of our own only in local mode, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"file://{_FALLBACK}").rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Arrow batches of at most ``rows`` texts and about ``size`` bytes (or one text) in place of Spark's defaults.

    A setting of the session, as Spark reads it when a plan runs; one that differs from the default stays.
    """
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", size)):
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Stage:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    ``put`` writes a frame and reads it back; ``drop`` deletes one that is no longer read, ``keep_only``
    all but those given. What a returned frame still reads is deleted when the session's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}", 0
        self.frames: dict[str, DataFrame] = {}  # by path; held, as the id of a frame that is gone may be another's
        atexit.register(self._close)

    def put(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.frames[path] = out
        return out

    def _path(self, frame: DataFrame) -> str | None:
        return next((p for p, f in self.frames.items() if f is frame), None)

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            if path := self._path(f):
                del self.frames[path]
                _delete(self.spark, path)

    def keep_only(self, *frames: DataFrame) -> None:
        kept = {self._path(f): f for f in frames}
        for i in range(self.n):
            if (path := f"{self.root}/{i}") not in kept:
                _delete(self.spark, path)
        self.frames = kept

    def _close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001 - the session is already gone; the folder's owner cleans it
            pass


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


def crc_bucket(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def connected_components(stage: Stage, edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of each component, for the nodes of edges (a, b).

    Alternates large-star and small-star until the edge set repeats: O(log^2 n) rounds, each a
    shuffle of at most the edges. Only two counts reach the driver. A node that a third of all
    edges touch is safe: the stars use the partially aggregated minimum of its neighbours, and the
    edges join that minimum with Spark's skew handling; no neighbour list is ever built.
    """
    e = stage.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        # large-star: each strictly larger neighbour of u is linked to u's smallest neighbour (or u)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: u and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        new = stage.put(small)
        stage.drop(e)
        e = new
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first())
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = now


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], salt, n: int = 16, how: str = "left") -> DataFrame:
    """A join for keys that may hold a third of left: its rows are dealt over ``n`` tasks a key by a hash of ``salt``.

    right, small beside left and with one row a key, is repeated n times.
    """
    a = left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(n)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
