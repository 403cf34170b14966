"""Quality scores from a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2]): all pairwise
interactions of a text's features in time linear in their number. Trained here on a bounded sample
of labelled rows; source, language, labels and ids are never features.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket
from .token_counts import worker_cache

BUCKETS = 1 << 15
#: Character classes that are counted.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!", b"?", b".", b",", b"#$%&*", b"|<>{}[]\\/=+~^_@", b"\n", b" ", b"'\"-:;()")
N_STATS = len(CLASSES) + 12


class Buckets(dict):
    """Word -> hash bucket, kept by the worker within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = got = zlib.crc32(word) % BUCKETS
        return got


def text_features(text: bytes, n_chars: int | None, get) -> tuple[list[int], list[float]]:
    """(hash buckets of the distinct lower-cased words, structure statistics with metadata)."""
    import math
    from collections import Counter

    words, n = text.lower().split(), max(len(text), 1)
    counts = Counter(words)
    total, distinct = max(len(words), 1), len(counts)
    lines = [x for x in text.split(b"\n") if x.strip()]
    own = Counter(lines)
    bare = text.translate(None, b"!#$%&*|")
    stats = [(len(text) - len(text.translate(None, c))) / n for c in CLASSES]
    stats += [
        math.log1p(len(words)), len(text) / total, distinct / total, max(counts.values(), default=0) / total,
        math.log1p(len(lines)), sum(k for k in own.values() if k > 1) / max(len(lines), 1), max(own.values(), default=0) / max(len(lines), 1),
        len(bare) / n, sum(1 for w in counts if len(w) > 20) / max(distinct, 1), sum(1 for w in words[:-1] if w[-1:] in b".!?") / total,
        len(set(zip(words, words[1:]))) / total, math.log1p(n_chars if n_chars is not None else len(text)),
    ]
    return list(set(map(get, counts))), stats


def _forward(np, w0, w, v, starts, index, value):
    """Scores by the sum-of-squares identity, with the sums that training needs again."""
    vx = v[index] * value[:, None]
    s = np.add.reduceat(vx, starts, axis=0)
    q = np.add.reduceat(vx * vx, starts, axis=0)
    z = w0 + np.add.reduceat(w[index] * value, starts) + 0.5 * (s * s - q).sum(axis=1)
    return z, s, vx


def gradients(np, err, s, vx, starts, index, value):
    """(used, dw, dv): of sum(err * z), for the features that rows use."""
    doc = np.repeat(np.arange(len(err)), np.diff(np.append(starts, len(index))))
    e = err[doc] * value
    used, back = np.unique(index, return_inverse=True)
    dv = [np.bincount(back, e * (s[doc, f] - vx[:, f]), len(used)) for f in range(s.shape[1])]
    return used, np.bincount(back, e, len(used)), np.stack(dv, axis=1)


def _design(np, rows, mean, scale):
    """Flat (starts, index, value): hashed words of unit length in all, then the statistics."""
    lengths = np.array([len(b) for b, _ in rows])
    stats = (np.array([s for _, s in rows], float).reshape(len(rows), N_STATS) - mean) / scale
    starts = np.concatenate(([0], np.cumsum(lengths + N_STATS)[:-1])).astype(np.int64)
    index = np.empty(int(lengths.sum()) + N_STATS * len(rows), np.int64)
    value = np.empty(len(index))
    fixed = np.arange(BUCKETS, BUCKETS + N_STATS)
    for k, (b, _) in enumerate(rows):
        at, end = starts[k], starts[k] + len(b)
        index[at:end] = b
        value[at:end] = 1 / max(len(b), 1) ** 0.5
        index[end : end + N_STATS] = fixed
        value[end : end + N_STATS] = np.clip(stats[k], -6, 6) / N_STATS**0.5
    return starts, index, value


def train(rows: list[tuple[list[int], list[float]]], y: list[int], rank: int = 8, epochs: int = 12, rate: float = 0.08, decay: float = 1e-4, seed: int = 7) -> dict:
    """Fit on (features, label) rows with AdaGrad over shuffled batches; deterministic for given rows."""
    import numpy as np

    rng = np.random.default_rng(seed)
    size = BUCKETS + N_STATS
    p = float(np.clip(np.mean(y), 0.01, 0.99)) if y else 0.5
    w0, w, v = float(np.log(p / (1 - p))), np.zeros(size), rng.normal(0, 0.05, (size, rank))
    stats = np.array([s for _, s in rows], float).reshape(len(rows), N_STATS)
    mean, scale = (stats.mean(axis=0), stats.std(axis=0) + 1e-6) if rows else (np.zeros(N_STATS), np.ones(N_STATS))
    if len(set(y)) < 2:
        v[:] = 0
    else:
        g0, gw, gv, target = 1e-6, np.full(size, 1e-6), np.full((size, rank), 1e-6), np.array(y, float)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 128):
                own = order[at : at + 128]
                starts, index, value = _design(np, [rows[i] for i in own], mean, scale)
                z, s, vx = _forward(np, w0, w, v, starts, index, value)
                err = (1 / (1 + np.exp(-z)) - target[own]) / len(own)
                used, dw, dv = gradients(np, err, s, vx, starts, index, value)
                dw, dv = dw + decay * w[used], dv + decay * v[used]
                g0 += err.sum() ** 2
                gw[used] += dw * dw
                gv[used] += dv * dv
                w0 -= rate * err.sum() / g0**0.5
                w[used] -= rate * dw / gw[used] ** 0.5
                v[used] -= rate * dv / gv[used] ** 0.5
    return {"w0": w0, "w": w, "v": v, "mean": mean, "scale": scale}


def _inputs(df: DataFrame, *more: str) -> DataFrame:
    n = F.col("n_chars").cast("long") if "n_chars" in df.columns else F.lit(None).cast("long")
    return df.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), n.alias("n_chars"), *more)


def fit(df: DataFrame, labels: DataFrame, sample: int = 12_000, folds: int = 5, held: int = 0) -> dict:
    """Train on at most ``sample`` labelled rows outside the held-out fold, chosen by a hash of doc_id.

    A doc_id with several labels takes the smallest; null labels or ids teach nothing.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), folds) != held))
    known = known.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = Buckets().__getitem__
        for b in batches:
            got = [text_features(t, n, get) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float64()))], ["doc_id", "y", "words", "stats"])

    kind = df.schema["doc_id"].dataType.simpleString()
    rows = _inputs(df.join(F.broadcast(known), "doc_id"), "y")  # at most ``sample`` rows of two numbers
    rows = rows.mapInArrow(run, f"doc_id {kind}, y int, words array<int>, stats array<double>")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("words", "stats")).limit(sample).toArrow().to_pydict()
    return train([(sorted(w), s) for w, s in zip(got["words"], got["stats"])], got["y"])


def score(df: DataFrame, model: dict, threshold: float = 0.3, carry: tuple[str, ...] = (), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """doc_id, score, predicted (by these or other ``names``) and the columns ``carry`` for every row.

    Null text counts as empty and gets a score like any other; null or repeated doc_ids keep their
    rows; without usable labels every score is 0.5. n_chars may be null or absent (then the text's
    bytes stand for it). Empty input: no rows. Other columns are ignored.
    """
    shared, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    held = ["doc_id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        m, cache = shared.value, worker_cache("buckets")
        if key not in cache:
            cache.clear()
            cache[key] = Buckets()
        get = cache[key].__getitem__
        for b in batches:
            z, part, size = [], [], 0
            texts, chars = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k, (t, n) in enumerate(zip(texts, chars)):
                part.append(text_features(t, n, get))
                size += len(part[-1][0])
                if size > 100_000 or k == len(texts) - 1:
                    z.append(_forward(np, m["w0"], m["w"], m["v"], *_design(np, part, m["mean"], m["scale"]))[0])
                    part, size = [], 0
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(z), -40, 40))) if z else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(b.column(i + 2) for i in range(len(held))), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*held, *names])

    kinds = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in held)
    n = F.col("n_chars").cast("long") if "n_chars" in df.columns else F.lit(None).cast("long")
    rows = df.select(F.coalesce("text", F.lit("")).cast("binary").alias("_text"), n.alias("_n"), *held)
    return rows.mapInArrow(run, f"{kinds}, `{names[0]}` double, `{names[1]}` int")
