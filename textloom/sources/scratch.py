"""Tables that iterative operators write between their rounds, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL = f"file:///tmp/checkpoints/textloom-{uuid.uuid4().hex[:12]}"


class Scratch:
    """``put`` writes a frame and reads it back: lineage ends there and lost executors cost their tasks alone.

    The folder is spark.checkpoint.dir; where that is unset, a folder of our own in local mode, and on a
    cluster an error. ``close`` deletes what was put; so does the end of the process.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        self.spark, self.root, self.n = spark, f"{(root or _LOCAL).rstrip('/')}/textloom/{name}-{uuid.uuid4().hex}", 0
        self._last: list[str] = []
        atexit.register(self._end)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self._last.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, keep: int = 1) -> None:
        """Delete all but the last ``keep`` tables."""
        old, self._last = self._last[: len(self._last) - keep], self._last[len(self._last) - keep :]
        for path in old:
            _delete(self.spark, path)

    def close(self) -> None:
        _delete(self.spark, self.root)

    def _end(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.close()
        except Exception:  # noqa: BLE001 - the session is already gone; the folder's owner cleans it
            pass


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
