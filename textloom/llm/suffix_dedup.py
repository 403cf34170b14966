"""Repeated byte strings by blockwise suffix sorting with a difference cover.

A byte is removed if a string of ``length`` bytes covers it that also starts anywhere else.

1. Winnowing picks anchors: the last of the smallest hashed ``gram``-byte strings in each window of
   ``length`` bytes. Equal windows pick equal anchors at equal offsets, so only windows around anchors
   that occur twice can repeat, and only these are sorted.
2. Around each such anchor, the context that its windows span is aligned at the anchor. Suffix buckets
   (one anchor and one offset) are sorted one at a time: by leading bytes up to the next position of a
   difference cover modulo 31, then by the precomputed ranks of cover samples, made by doubling, which
   settle long ties without walking through them. Neighbours that agree over ``length`` bytes repeat.
3. An anchor with more than ``hot`` different contexts is too large to sort at once: its contexts are dealt
   to smaller buckets by the bytes beside the anchor, again and again, until each can be sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Stage

#: A perfect difference cover: every difference modulo 31 is one of two members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
PIECE = 1 << 18  # bytes that are hashed at once, some twenty numbers of eight bytes each
BASE, MIX = 0xD1342543DE82EF95, 0x9E3779B97F4A7C15


def _powers(np):
    """Of BASE and its inverse modulo 2**64, and a random number for each byte value."""

    def powers(base: int):
        steps = np.full(PIECE + 2, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return powers(BASE), powers(pow(BASE, -1, 1 << 64)), np.random.default_rng(5).integers(1, 1 << 63, 256).astype(np.uint64)


def anchors(np, powers, texts: list[bytes], length: int, gram: int) -> list[tuple]:
    """For each text, (positions, hashes) of its anchors."""
    up, down, letter = powers
    out = [([], []) for _ in texts]
    pieces, size, window = [], 0, length - gram + 1

    def flush() -> None:
        nonlocal pieces, size
        data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        n = len(data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(letter[data] * up[:n], out=total[1:])
        h = (total[gram:] - total[:-gram]) * down[: n - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
        h ^= h >> np.uint64(29)
        places = np.arange(len(h), dtype=np.uint64)
        low = np.uint64((1 << 22) - 1)
        key = (h & ~low) | (low - places)  # of equal hashes, the last
        blocks = -(-len(key) // window)
        padded = np.full(blocks * window, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(key)] = key
        table = padded.reshape(blocks, window)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - length + 1
        least = np.minimum(behind[:starts], ahead[window - 1 : window - 1 + starts])
        valid, at = np.ones(starts, bool), 0
        for _, _, piece in pieces:
            valid[max(at + len(piece) - length + 1, 0) : at + len(piece)] = False
            at += len(piece)
        picked = np.zeros(len(h), bool)
        picked[(low - (least[valid] & low)).astype(np.int64)] = True
        found, at = np.nonzero(picked)[0], 0
        for k, offset, piece in pieces:
            a, b = np.searchsorted(found, (at, at + len(piece)))
            own = found[a:b]
            out[k][0].append(own - at + offset)
            out[k][1].append(h[own].view(np.int64))
            at += len(piece)
        pieces, size = [], 0

    for k, t in enumerate(texts):
        for offset in range(0, max(len(t) - length + 1, 0), PIECE // 2 - length + 1):
            piece = t[offset : offset + PIECE // 2]
            if size + len(piece) > PIECE:
                flush()
            pieces.append((k, offset, piece))
            size += len(piece)
    if pieces:
        flush()
    none = np.empty(0, np.int64)
    done = []
    for places, hashes in out:
        places, first = np.unique(np.concatenate([none, *places]), return_index=True)
        done.append((places, np.concatenate([none, *hashes])[first]))
    return done


def _names(np, *keys):
    """Dense ranks from 1 of rows by several keys, most significant first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new) + 1
    return ranks


def repeated_offsets(np, group, data, first, last, length: int):
    """(n, offsets) booleans: whether the string of ``length`` bytes at an offset recurs in its group.

    ``data``: contexts as rows of bytes, aligned; ``first`` and ``last``: each row's whole windows.
    """
    n, width = data.shape
    offsets = width - length + 1
    wide = np.zeros((n, width + 32), np.uint8)
    wide[:, :width] = data

    def words(at: int, size: int) -> list:
        """The bytes [at, at + size), at most 32, as big-endian numbers."""
        own = np.zeros((n, 8 * -(-size // 8)), np.uint8)
        own[:, :size] = wide[:, at : at + size]
        return list(own.view(">u8").astype(np.uint64).T)

    # ranks of the cover samples: by 31 bytes, then doubled while a window holds two such blocks
    sample = [c for c in range(width - PERIOD + 1) if c % PERIOD in COVER]
    rank = {c: _names(np, group, *words(c, PERIOD)) for c in sample}
    depth = PERIOD
    while 2 * depth <= length - 2 * PERIOD:
        rank = {c: _names(np, rank[c], rank[c + depth]) for c in rank if c + depth in rank}
        depth *= 2
    out = np.zeros((n, offsets), bool)
    for j in range(offsets):  # one suffix bucket at a time
        rows = np.nonzero((first <= j) & (last >= j))[0]
        if len(rows) < 2:
            continue
        at = next(c for c in range(j, width) if c in rank)
        keys = [group, *(words(j, at - j) if at > j else [])]
        while True:
            keys.append(rank[at])
            at += depth
            if at + depth <= j + length:
                while at not in rank:  # step back to a sample that overlaps what is settled
                    at -= 1
                continue
            break
        if at < j + length:  # the rest: a block that ends within a period of the string's end, then single bytes
            near = next(c for c in range(j + length - depth, j, -1) if c in rank)
            keys.append(rank[near])
            if near + depth < j + length:
                keys += words(near + depth, j + length - near - depth)
        keys = [k[rows] for k in keys]
        order = np.lexsort(keys[::-1])
        same = np.ones(len(rows) - 1, bool)
        for k in keys:
            s = k[order]
            same &= s[1:] == s[:-1]
        out[rows[order[1:][same]], j] = True
        out[rows[order[:-1][same]], j] = True
    return out


def _runs(np, flags) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[::2].tolist(), edge[1::2].tolist()


def _sorted_buckets(buckets: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, context, lo array, hi array): per row of ``buckets``, the runs [lo, hi) of its offsets first..last that repeat in its bucket."""
    side = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            data = np.zeros((len(rows), length + side), np.uint8)
            for i, r in enumerate(rows):
                data[i, side - r[3] : side - r[3] + len(r[7])] = np.frombuffer(r[7], np.uint8)
            first, last = np.array([r[5] for r in rows], np.int64), np.array([r[6] for r in rows], np.int64)
            _, group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
            found = repeated_offsets(np, group, data, first, last, length)
            lo, hi = [], []
            for i, r in enumerate(rows):
                if r[4] > 1:
                    found[i, first[i] : last[i] + 1] = True
                a, b = _runs(np, found[i])
                lo.append(a)
                hi.append(b)
            ints = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array(lo, ints), pa.array(hi, ints)], ["h", "context", "lo", "hi"])

        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if len(held) >= 1024 and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    rows = buckets.select("bucket", "h", "context", "left", "times", "first", "last", "bytes").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(run, "h long, context binary, lo array<int>, hi array<int>")


def _refined(stage: Stage, buckets: DataFrame, length: int, hot: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Buckets of more than ``hot`` contexts, split by longer shared strings until each can be sorted.

    The contexts of a bucket share the bytes [s, e). Every window holds the half of its free bytes next to
    these on the left, or else more than half on the right: so a context goes to one bucket by its bytes
    on the left, for the windows that hold them, and to one by those on the right, for the others. A
    context alone in a bucket repeats nothing there. Of contexts that agree in all their windows there,
    which repeat whole, one goes on. Returns buckets to sort, and runs of windows that repeat whole.
    """
    small, whole = [], []
    live = buckets
    while not live.isEmpty():
        half = F.ceil((F.lit(length) - (F.col("e") - F.col("s"))) / 2).cast("int")
        part = lambda lo, hi: F.substring("bytes", lo - F.col("origin") + 1, hi - lo)
        to_left = F.struct(F.lit(0).alias("way"), (F.col("s") - half).alias("s"), F.col("e").alias("e"), F.col("first").alias("first"), F.least(F.col("last"), F.col("s") - half).alias("last"), part(F.col("s") - half, F.col("s")).alias("string"))
        end = F.col("s") - half + 1 + length
        to_right = F.struct(F.lit(1).alias("way"), F.col("s").alias("s"), end.alias("e"), F.greatest(F.col("first"), F.col("s") - half + 1).alias("first"), F.col("last").alias("last"), part(F.col("e"), end).alias("string"))
        split = live.select("bucket", "h", "context", "left", "origin", "times", "bytes", F.explode(F.array(to_left, to_right)).alias("x")).where("x.first <= x.last")
        split = split.select(F.xxhash64("bucket", "x.way", "x.string").alias("bucket"), "h", "context", "left", "origin", "times", "bytes", "x.s", "x.e", "x.first", "x.last")
        split = stage.put(split.withColumn("all", F.unhex(F.md5(part(F.col("first"), F.col("last") + length)))))
        same = ["bucket", "first", "last", "all"]
        twins = stage.put(split.groupBy(*same).agg(F.count("*").alias("k"), F.min("context").alias("one")).where("k > 1"))
        joined = stage.put(split.join(twins, same, "left").drop("all"))
        stage.drop(split, twins)
        whole.append(joined.where("k > 1").select("h", "context", F.array("first").alias("lo"), F.array(F.col("last") + 1).alias("hi")))
        left = joined.where("k is null or context = one").withColumn("times", F.col("times") + F.coalesce(F.col("k") - 1, F.lit(0))).drop("k", "one")
        sizes = stage.put(left.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1"))
        left = stage.put(left.join(sizes, "bucket"))
        small.append(left.where(F.col("k") <= hot).drop("k"))
        live = left.where((F.col("k") > hot) & (F.col("e") - F.col("s") < length)).drop("k")
    return small, whole


class Repeats:
    """What repeats in (doc_id, text) rows.

    spans: text_key, spans (array of (lo, hi) in bytes, maximal and in order) of texts that repeat anything.
    """

    def __init__(self, df: DataFrame, length: int = 400, gram: int | None = None, hot: int = 2048):
        gram = gram or length // 2
        stage = Stage(df.sparkSession, "repeats")
        text = F.coalesce("text", F.lit("")).cast("binary")
        docs = df.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), text_key(F.col("text")).alias("text_key"))
        kind = df.schema["doc_id"].dataType.simpleString()

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            powers = _powers(np)
            for b in batches:
                got = anchors(np, powers, b.column(1).to_pylist(), length, gram)
                more = [pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 2, 3)), *more], ["doc_id", "n_bytes", "text_key", "pos", "hash"])

        picked = stage.put(docs.mapInArrow(pick, f"doc_id {kind}, n_bytes long, text_key binary, pos array<int>, hash array<long>"))
        distinct = stage.put(picked.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("n_bytes").alias("n_bytes"), F.first("pos").alias("pos"), F.first("hash").alias("hash")))
        at = distinct.select("text_key", F.inline(F.arrays_zip("pos", "hash")).alias("pos", "h"))
        # written first: beside an aggregate of its own stage, the join couldn't split an anchor that many texts hold
        twice = stage.put(at.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
        places = at.join(twice, "h", "left_semi").groupBy("text_key").agg(F.collect_list(F.struct("pos", "h")).alias("places"))
        places = places.join(distinct.select("text_key", "rep"), "text_key")
        # one row of equal texts is enough; of repeated rows of one id, all come and count once below
        held = docs.select("text_key", "doc_id", "text").join(places.hint("shuffle_hash"), "text_key").where(F.col("doc_id").eqNullSafe(F.col("rep")))
        held = stage.put(held.select("text_key", "text", "places"))
        side = length - gram

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys, pos, h, left, ctx = [], [], [], [], []
                for key, text, places in zip(*(c.to_pylist() for c in b.columns)):
                    own: dict[tuple, list[int]] = {}
                    for p in places:
                        a = max(p["pos"] - side, 0)
                        own.setdefault((p["h"], p["pos"] - a, text[a : p["pos"] + length]), []).append(p["pos"])
                    for (x, y, z), places_of in own.items():
                        keys.append(key)
                        pos.append(sorted(set(places_of)))
                        h.append(x)
                        left.append(y)
                        ctx.append(z)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(pos, pa.list_(pa.int32())), pa.array(h, pa.int64()), pa.array(left, pa.int32()), pa.array(ctx, pa.binary())], ["text_key", "pos", "h", "left", "bytes"])

        around = held.mapInArrow(cut, "text_key binary, pos array<int>, h long, left int, bytes binary")
        around = stage.put(around.withColumn("context", F.unhex(F.md5(F.concat(F.col("left").cast("string").cast("binary"), F.lit(b":"), F.col("bytes"))))))
        once = around.select("text_key", "pos", "h", "context").distinct()
        counts = once.groupBy("h", "context").agg(F.sum(F.size("pos")).alias("times"))
        contexts = around.groupBy("h", "context").agg(F.first("left").alias("left"), F.first("bytes").alias("bytes")).join(counts, ["h", "context"])
        contexts = stage.put(contexts)
        # each side written first, for the same reason
        sizes = stage.put(contexts.groupBy("h").agg(F.count("*").alias("n"), F.sum("times").alias("all")).where(F.col("all") > 1))
        contexts = stage.put(contexts.join(sizes, "h"))
        origin = F.lit(side) - F.col("left")  # where a context's bytes begin, when all are aligned at the anchor
        last = origin + F.length("bytes") - length
        buckets = contexts.select("*", F.col("h").alias("bucket"), origin.alias("origin"), F.lit(side).alias("s"), F.lit(side + gram).alias("e"), origin.alias("first"), last.alias("last")).where("first <= last")
        found = _sorted_buckets(buckets.where(F.col("n") <= hot), length, gram)
        crowded = buckets.where(F.col("n") > hot)
        small, whole = _refined(stage, crowded, length, hot)
        if whole:
            many = crowded.where("times > 1").select("h", "context", F.array("first").alias("lo"), F.array(F.col("last") + 1).alias("hi"))
            for part in [*(_sorted_buckets(x, length, gram) for x in small), *whole]:
                many = many.unionByName(part)
            # the runs that a context has from its buckets, at most one an offset, as one list of runs
            many = many.select("h", "context", F.flatten(F.zip_with("lo", "hi", lambda a, b: F.sequence(a, b - 1))).alias("o"))
            many = many.groupBy("h", "context").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("o")))).alias("o"))
            found = found.unionByName(many.select("h", "context", F.filter("o", lambda x, i: (i == 0) | (F.get("o", i - 1) < x - 1)).alias("lo"), F.transform(F.filter("o", lambda x, i: (i == F.size("o") - 1) | (F.get("o", i + 1) > x + 1)), lambda x: x + 1).alias("hi")))
        runs = stage.put(found.where(F.size("lo") > 0).select("h", "context", F.arrays_zip("lo", "hi").alias("runs")))
        # a run's windows at the places of a context overlap or touch unless the places lie further apart than the run is wide
        wide = lambda r: r["hi"] - r["lo"] - 1 + length
        starts = lambda r: F.filter("pos", lambda p, i: (i == 0) | (p - F.get("pos", i - 1) > wide(r)))
        ends = lambda r: F.filter("pos", lambda p, i: (i == F.size("pos") - 1) | (F.get("pos", i + 1) - p > wide(r)))
        at = lambda r: F.zip_with(starts(r), ends(r), lambda a, b: F.struct((a - side + r["lo"]).cast("long").alias("lo"), (b - side + r["hi"] - 1 + length).cast("long").alias("hi")))
        self.places = spans = once.join(runs, ["h", "context"]).select("text_key", F.inline(F.flatten(F.transform("runs", at))))
        order = W.partitionBy("text_key").orderBy("lo")
        reached = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
        spans = spans.withColumn("new", F.coalesce(F.col("lo") > reached, F.lit(True)).cast("int"))
        spans = spans.withColumn("span", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        spans = spans.groupBy("text_key", "span").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        spans = spans.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
        copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
        all_of = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")))
        both = distinct.select("text_key", "copies", "n_bytes").join(spans, "text_key", "left")
        both = both.select("text_key", F.when(copied, all_of).otherwise(F.col("spans")).alias("spans"))
        self.spans = stage.put(both.where(F.col("spans").isNotNull()))
        stage.keep_only(self.spans)


def text_key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def _with_spans(df: DataFrame, length: int, **options) -> DataFrame:
    """df with ``_spans``, null where nothing repeats."""
    spans = Repeats(df, length, **options).spans.select(F.col("text_key").alias("_key"), F.col("spans").alias("_spans"))
    return df.withColumn("_key", text_key(F.col("text"))).join(spans, "_key", "left").drop("_key")


def kept_digests(df: DataFrame, length: int = 400, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, text for every row of (doc_id, text).

    spans: the removed runs as (lo, hi) in bytes. text: what is left, U+FFFD where a cut split a
    character; kept_sha256 is of the bytes themselves. Matches are judged on the input and never cross
    texts. Null text counts as empty; a text shorter than ``length`` bytes keeps all. Null or repeated
    doc_ids keep their rows, and rows of equal text repeat each other. Empty input: no rows. Other
    columns are ignored.
    """
    kind = df.schema["doc_id"].dataType.simpleString()
    rows = _with_spans(df.select("doc_id", "text"), length, **options)
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce("_spans", F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)")).alias("spans"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, digests, texts, sizes = [], [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                at, kept = 0, []
                for s in spans:
                    kept.append(text[at : s["lo"]])
                    at = s["hi"]
                left = b"".join([*kept, text[at:]])
                sizes.append(len(text))
                removed.append(len(text) - len(left))
                digests.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), b.column(2), pa.array(texts)], ["doc_id", "n_bytes", "n_removed", "kept_sha256", "spans", "text"])

    out = rows.mapInArrow(keep, f"doc_id {kind}, n_bytes long, n_removed long, kept_sha256 string, spans array<struct<lo:bigint,hi:bigint>>, text string")
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans", "text")


def without_repeats(df: DataFrame, length: int = 400, **options) -> DataFrame:
    """df, all columns, with repeated bytes cut from ``text`` (never within a character); null text stays null."""
    names = df.columns

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = names.index("text")
        for b in batches:
            out = []
            for text, spans in zip(b.column(i).to_pylist(), b.column(len(names)).to_pylist()):
                if text is not None and spans:
                    raw, at, kept = text.encode(), 0, []
                    inside = lambda p: p < len(raw) and raw[p] & 0xC0 == 0x80  # noqa: E731, B023
                    for s in spans:
                        lo, hi = s["lo"], s["hi"]
                        while inside(lo):
                            lo += 1
                        while inside(hi):
                            hi -= 1
                        kept.append(raw[at:lo])
                        at = max(at, hi)
                    text = b"".join([*kept, raw[at:]]).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == i else b.column(k) for k in range(len(names))], names)

    return _with_spans(df, length, **options).select(*names, "_spans").mapInArrow(trim, df.schema)
