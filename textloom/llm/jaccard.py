"""The exact check behind near copies: Jaccard similarity of sets of word shingles, 4/5 or more.

Candidates meet a bound first: each bit of one set's signature that the other's lacks is a shingle that the
other lacks. No pair of similarity 4/5 fails it; only the sets of the texts that are left are fetched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage

PRIME = 0x9E3779B97F4A7C15
#: Longs of a signature.
LONGS = 16
#: Ids that are broadcast at most to pick texts; more are joined by a shuffle.
FEW = 1_000_000


def shingles(text: bytes | None, k: int):
    """The set of hashed k-word shingles, sorted; a shorter text is one shingle, an empty one none."""
    import numpy as np
    import xxhash

    words = text.lower().split() if text else []  # of bytes: A-Z alone, and white space 0x09-0x0D and 0x20
    if not words:
        return np.zeros(0, np.int64)
    w, k = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), min(k, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : len(words) - k + 1 + j]) * np.uint64(PRIME)
        h ^= h >> np.uint64(31)
    return np.unique(h.view(np.int64))


def signature(np, s):
    """Which residues of the hashes a set holds, as LONGS longs."""
    bits = np.zeros(64 * LONGS, np.uint8)
    bits[s & (64 * LONGS - 1)] = 1
    return np.packbits(bits).view(np.int64)


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """(tid, shingles) for every row of (tid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, k) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["tid", "shingles"])

    return texts.mapInArrow(run, "tid long, shingles array<long>")


def may_be_similar(a: str, b: str) -> Column:
    """Whether the signatures and sizes (columns n, signature) of two frames by these names allow similarity 4/5."""
    lacks = lambda x, y: sum((F.bit_count(F.col(f"{x}.signature")[i].bitwiseAND(F.bitwise_not(F.col(f"{y}.signature")[i]))) for i in range(LONGS)), F.lit(0))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - lacks(a, b), m - lacks(b, a)) >= 4 * (n + m))


def similar(stage: Stage, pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) of tids whose sets have similarity 4/5 or more; texts: (tid, text), repeats allowed."""
    pairs = stage.put(pairs.distinct())
    wanted = stage.put(pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    own = stage.put(_sets(texts.join(wanted, "tid", "left_semi").dropDuplicates(["tid"]), k))
    a, b = (own.select(F.col("tid").alias(x), F.col("shingles").alias(f"{x}_shingles")) for x in "ab")
    both = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return stage.put(pairs.join(a, "a").join(b, "b").where(9 * both >= 4 * (F.size("a_shingles") + F.size("b_shingles"))).select("a", "b"))
