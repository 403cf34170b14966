"""Encoding of a corpus by a model that each worker holds.

Texts of an Arrow batch are sorted by length and dealt into model batches of bounded padded size, so
that short texts aren't padded to long ones. A batch that doesn't fit into memory is split and tried
again, down to single texts. A corpus is encoded in parts by a hash of its ids; parts that are written
stay, and a run that was broken off goes on with the others.

A model is made by a function without arguments and called with a list of texts, longest last; it
returns a matrix. It runs inside tasks, on what Spark has dealt to them.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.versions import exists


def held(name: str, make: Callable):
    """The model of that name, made once a Python worker; one is held at a time."""
    models = sys.modules.setdefault("_textloom_models", type(sys)("_textloom_models")).__dict__
    found = models.get("held")
    if found is None or found[0] != name:
        models["held"] = None
        models["held"] = found = (name, make())
    return found[1]


def padded_batches(lengths: list[int], room: int, most: int) -> list[tuple[int, int]]:
    """Ranges of ascending lengths whose number times longest stays within ``room``; a longer text is alone. At most ``most`` each."""
    out, start = [], 0
    for i, n in enumerate(lengths):
        if i > start and ((i + 1 - start) * n > room or i - start >= most):
            out.append((start, i))
            start = i
    return [*out, (start, len(lengths))] if lengths else []


def halving(call: Callable, items: list, out_of_memory: tuple[type, ...] = (MemoryError,)) -> list:
    """call(items), a list of one result an item; where memory runs out, of the halves. A single item that doesn't fit raises."""
    try:
        return list(call(items))
    except out_of_memory:
        if len(items) <= 1:
            raise
    half = len(items) // 2
    return halving(call, items[:half], out_of_memory) + halving(call, items[half:], out_of_memory)


def by_length(call: Callable, items: list, lengths: list[int], room: int, most: int) -> list:
    """One result an item, in the order of items, from batches of similar length."""
    order = sorted(range(len(items)), key=lengths.__getitem__)
    out: list = [None] * len(items)
    for a, b in padded_batches([lengths[i] for i in order], room, most):
        own = order[a:b]
        for i, x in zip(own, halving(call, [items[i] for i in own])):
            out[i] = x
    return out


def encode(df: DataFrame, make: Callable, keys: list[str], text: str, name: str = "encoder", room: int = 16_384, most: int = 256, unit: bool = True, kind: str = "float") -> DataFrame:
    """keys and embedding (array of ``kind``) for every row. ``room``: words of a padded batch; ``most``: texts of one.

    Null text is empty. ``unit``: vectors are divided by their length, zero vectors stay.
    """
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + f", embedding array<{kind}>"
    names = [*keys, "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model = held(name, make)
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(len(keys)).to_pylist()
            rows = np.asarray(by_length(model, texts, [x.count(" ") + 1 for x in texts], room, most), float)
            if unit:
                size = np.sqrt((rows * rows).sum(1, keepdims=True))
                rows = rows / np.where(size > 0, size, 1.0)
            flat = pa.array(rows.astype(np.float32 if kind == "float" else np.float64).reshape(-1))
            offsets = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.ListArray.from_arrays(offsets, flat)], names)

    return df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, schema)


def encode_parts(df: DataFrame, make: Callable, keys: list[str], text: str, path: str, parts: int = 16, **options) -> DataFrame:
    """``encode`` to ``path``, a folder for each of ``parts`` hash ranges of the keys; complete ones are kept.

    Each part reads df's rows of its range: df should be a written table, and ``parts`` as few as make a broken
    run's loss bearable, for df is read once a part. What a part holds follows from
    its rows alone, so a run with other tables, models or numbers of parts needs another path.
    """
    spark, part = df.sparkSession, F.pmod(F.xxhash64(*keys), F.lit(parts))
    at = lambda i: f"{path}/{i:05d}-of-{parts:05d}"
    for i in range(parts):
        if not exists(spark, f"{at(i)}/_SUCCESS"):
            encode(df.where(part == i), make, keys, text, **options).write.mode("overwrite").parquet(at(i))
    return spark.read.parquet(*[at(i) for i in range(parts)])


def score_pairs(df: DataFrame, make: Callable, query: str, text: str, name: str = "scorer", out: str = "score", room: int = 16_384, most: int = 256) -> DataFrame:
    """df with a score of each (query, text) pair: pairs are dealt into batches by joint length, like texts of ``encode``.

    The model takes a list of pairs and returns a number for each. Rows keep their columns and number.
    """
    names, at = [*df.columns, out], (df.columns.index(query), df.columns.index(text))
    schema = df.select("*", F.lit(0.0).alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(name, make)
        for b in batches:
            if not b.num_rows:
                continue
            pairs = list(zip(*([x or "" for x in b.column(i).to_pylist()] for i in at)))
            scores = by_length(model, pairs, [q.count(" ") + t.count(" ") + 2 for q, t in pairs], room, most)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([float(s) for s in scores])], names)

    return df.mapInArrow(run, schema)


def padding(lengths: DataFrame, length: str, room: int = 16_384, most: int = 256, block: int = 10_000) -> DataFrame:
    """One row: words, words with padding in batches of rows as they come, and in batches by length, for blocks of ``block`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = plain = dealt = 0
        for b in batches:
            every = b.column(0).to_pylist()
            for i in range(0, len(every), block):
                own = every[i : i + block]
                ordered = sorted(own)
                words += sum(own)
                plain += sum(len(x) * max(x) for x in (own[j : j + most] for j in range(0, len(own), most)))
                dealt += sum((q - p) * ordered[q - 1] for p, q in padded_batches(ordered, room, most))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (words, plain, dealt)], ["words", "plain", "dealt"])

    rows = lengths.select(F.col(length).cast("long").alias("n")).mapInArrow(run, "words long, plain long, dealt long")
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "plain", "dealt")])
