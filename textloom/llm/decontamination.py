"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items that share a seed, a run of ``least`` words, are tiled: again and again the
longest non-overlapping common runs, found by running Karp-Rabin, are marked in both, down to
``least`` words. The share of an item's words under tiles is its coverage, whatever the order of the
passages in the text.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage
from .token_counts import worker_cache

#: A character of a script that is written without spaces (kana, Han, Thai, Lao, the higher planes) is a word by itself.
ALONE = rb"[\xe3-\xe9][\x80-\xbf][\x80-\xbf]|\xe0[\xb8-\xbb][\x80-\xbf]|\xf0[\x80-\xbf]{3}"
WORD = re.compile(ALONE + rb"|(?:[0-9a-z]|(?!" + ALONE + rb")[\x80-\xff])+")
MOD, BASE = (1 << 61) - 1, 1_000_003


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def _rolling(ids, marked, length: int):
    """(start, hash) of every unmarked window of ``length``."""
    top, run, h = pow(BASE, length - 1, MOD), 0, 0
    for i, x in enumerate(ids):
        if marked[i]:
            run = h = 0
            continue
        if run >= length:
            h = (h - ids[i - length] * top) % MOD
        h = (h * BASE + x) % MOD
        run += 1
        if run >= length:
            yield i - length + 1, h


def tile(item: list[int], text: list[int], closed: list[bool], least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length): always the longest run of unmarked places that both share, ties to the
    first in the item, then in the text, down to ``least``. ``closed`` text positions take no part."""
    in_item, in_text, tiles = [False] * len(item), list(closed), []
    length = max(least, min(len(item), 20))
    while True:
        windows: dict[int, list[int]] = {}
        for at, h in _rolling(text, in_text, length):
            windows.setdefault(h, []).append(at)
        # all maximal runs of this length or more; what is marked meanwhile cuts them into shorter ones
        runs = []
        for a, h in _rolling(item, in_item, length):
            for b in windows.get(h, ()):
                if a and b and not in_item[a - 1] and not in_text[b - 1] and item[a - 1] == text[b - 1]:
                    continue  # not the start of its run
                n = 0
                while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and not in_item[a + n] and not in_text[b + n]:
                    n += 1
                if n >= length:
                    runs.append((-n, a, b))
        heapq.heapify(runs)
        while runs:
            n, a, b = heapq.heappop(runs)
            free = [not in_item[a + k] and not in_text[b + k] for k in range(-n)]
            if all(free):
                in_item[a : a - n] = in_text[b : b - n] = [True] * -n
                tiles.append((a, b, -n))
                continue
            start = None
            for k, open_here in enumerate([*free, False]):
                if open_here and start is None:
                    start = k
                elif not open_here and start is not None:
                    if k - start >= length:
                        heapq.heappush(runs, (start - k, a + start, b + start))
                    start = None
        if length == least:
            return tiles
        length = max(least, length // 2)


class Items:
    """A block of the benchmark: vocabulary, items as ids, and the items of each seed.

    A seed is a run of ``least`` words, or a whole item of fewer.
    """

    def __init__(self, rows: list[tuple[object, list[bytes]]], least: int):
        import numpy as np

        self.names = [i for i, _ in rows]
        self.ids: dict[bytes, int] = {}
        self.items = [[self.ids.setdefault(w, len(self.ids) + 1) for w in own] for _, own in rows]
        self.least = [min(least, len(own)) for own in self.items]
        self.of: dict[int, dict[int, list[int]]] = {}  # by a seed's words, then by its hash
        for k, own in enumerate(self.items):
            for h in set(self.seeds(np, np.array(own, np.uint64), self.least[k]).tolist()):
                self.of.setdefault(self.least[k], {}).setdefault(h, []).append(k)
        self.keys = {n: np.array(sorted(of), np.uint64) for n, of in self.of.items()}

    @staticmethod
    def seeds(np, ids, size: int):
        """Hashes of all windows of ``size`` ids; 0 where one holds an unknown word."""
        n = len(ids) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        h, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for j in range(size):
            part = ids[j : j + n]
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            known &= part > 0
        return np.where(known, h | np.uint64(1), np.uint64(0))

    def matches(self, np, tokens: list[bytes], threshold: float) -> list[tuple[object, int, float, int]]:
        """(item, matched words, coverage, tiles) of the items covered to the threshold."""
        get = self.ids.get
        ids = np.array([get(w, 0) for w in tokens], np.uint64)
        open_at: dict[int, list[int]] = {}
        for size, keys in self.keys.items():
            seeds = self.seeds(np, ids, size)
            at = np.searchsorted(keys, seeds)
            hits = np.nonzero(keys[np.minimum(at, len(keys) - 1)] == seeds)[0] if len(seeds) else ()
            for p in map(int, hits):
                for k in self.of[size][int(seeds[p])]:
                    open_at.setdefault(k, []).append(p)
        out = []
        for k, places in sorted(open_at.items()):
            near = sorted({q for p in places for q in range(p, p + self.least[k])})
            # shared runs lie within seeds; a gap between them is closed by one dead position
            own, closed, before = [], [], None
            for q in near:
                if before is not None and q != before + 1:
                    own.append(0)
                    closed.append(True)
                own.append(int(ids[q]))
                closed.append(False)
                before = q
            tiles = tile(self.items[k], own, closed, self.least[k])
            matched = sum(n for _, _, n in tiles)
            if matched >= threshold * len(self.items[k]):
                out.append((self.names[k], matched, matched / len(self.items[k]), len(tiles)))
        return out


def benchmark_blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark's items in blocks of about ``block`` rows each, so that no broadcast grows with it."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", F.col("text").cast("binary").alias("text"))
    n = max(1, math.ceil(rows.count() / block))
    for i in range(n):
        got = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).orderBy("item_id", "text").toArrow().to_pydict()
        yield list(zip(got["item_id"], got["text"]))


def _matched(df: DataFrame, shared, item_type: str, least: int, threshold: float) -> DataFrame:
    """df with ``_leaks``: array of (item_id, matched, coverage, tiles). shared: a broadcast of plain (item_id, text) rows."""
    names, key = df.columns, uuid.uuid4().hex
    leak = f"array<struct<item_id:{item_type},matched:int,coverage:double,tiles:int>>"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    keys = ("item_id", "matched", "coverage", "tiles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from pyspark.sql.pandas.types import to_arrow_type
        from pyspark.sql.types import _parse_datatype_json_string

        cache = worker_cache("benchmark")
        if key not in cache:
            cache.clear()
            own = [(k, words(t)) for k, t in shared.value]
            cache[key] = Items([x for x in own if x[1]], least)
        own, kind = cache[key], to_arrow_type(_parse_datatype_json_string(leak_json))
        for b in batches:
            got = [[dict(zip(keys, m)) for m in own.matches(np, words(t), threshold)] for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(got, kind)], [*names, "_leaks"])

    from pyspark.sql.types import StructType

    leak_json = StructType.fromDDL(f"x {leak}")["x"].dataType.json()
    return df.select("*", F.col("text").cast("binary").alias("_text")).mapInArrow(run, f"{kinds}, _leaks {leak}")


def leaks(df: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, block: int = 20_000) -> DataFrame:
    """doc_id, item_id, matched, coverage, tiles: a row for each text and item covered to ``threshold``.

    Words are runs of letters (A-Z lower-cased) and digits, and single characters of scripts written
    without spaces. ``least``: words of a seed and of the shortest tile; an item of fewer words is one
    tile or none. Every text faces every item that it shares a seed with, one block of about ``block``
    items after the other: only one block is held at a time.

    Null or empty texts and items hold nothing; null item_ids take no part. Null or repeated doc_ids keep
    their rows; repeated item_ids are tiled each. Empty tables: no rows. Other columns are ignored.
    """
    spark, item, out = df.sparkSession, benchmark.schema["item_id"].dataType.simpleString(), None
    stage, shared = Stage(spark, "leaks"), None
    for rows in benchmark_blocks(benchmark, block):
        if shared is not None:
            got = stage.put(got)
            shared.unpersist()
            out = got if out is None else out.unionByName(got)
        shared = spark.sparkContext.broadcast(rows)
        got = _matched(df.select("doc_id", "text"), shared, item, least, threshold).select("doc_id", F.inline("_leaks"))
    return got if out is None else out.unionByName(got)


def decontaminated(df: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, block: int = 20_000) -> DataFrame:
    """The rows of df, all columns, of which no benchmark item is covered to ``threshold``; see ``leaks``."""
    spark, names, item = df.sparkSession, df.columns, benchmark.schema["item_id"].dataType.simpleString()
    stage, shared = Stage(spark, "leaks"), None
    for rows in benchmark_blocks(benchmark, block):
        if shared is not None:
            df = stage.put(df)
            shared.unpersist()
        shared = spark.sparkContext.broadcast(rows)
        df = _matched(df, shared, item, least, threshold).where(F.size("_leaks") == 0).select(*names)
    return df
