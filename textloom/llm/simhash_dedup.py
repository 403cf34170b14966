"""SimHash near-duplicates found through an inverted index over fingerprint bytes.

Two fingerprints at ``radius`` or fewer differing bits agree in at least 8 - radius of their eight
positional bytes. Postings are keyed by byte positions and their values, wide enough to stay short;
for each pair that meets in a posting the shared positional bytes are tallied, pairs below the
guaranteed minimum fall away, and the rest are verified bit by bit.

A posting that holds more than ``posting`` fingerprints (a large family of near copies) isn't
paired up. Its members go another, exact way: at radius 2, two fingerprints link if and only if some
centre lies within one bit of both, so members are grouped by the centres around them and linked to
each group's smallest; at most 65 fingerprints can share a centre.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, connected_components, spread_join
from .jaccard import may_be_similar, shingles, signature, similar

SEED = 42
#: Odd multipliers that turn one hash into those of further lanes: the k-th odd number times this one.
LANE = 0x9E3779B97F4A7C15


def _lanes(np, hashes, weights, lanes: int) -> list[int]:
    """In each lane, the bits that more than half of the weight sets, as signed 64-bit numbers."""
    out = []
    for lane in range(lanes):
        h = hashes
        if lane:
            h = h * np.uint64((2 * lane + 1) * LANE & (2**64 - 1))
            h = (h ^ (h >> np.uint64(29))) * np.uint64(LANE)
            h ^= h >> np.uint64(32)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 8192):
            bits = np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64) if weights is None else weights[at : at + 8192] @ bits
        out.append(int(np.packbits(2 * ones > (len(h) if weights is None else weights.sum()), bitorder="little").view(np.int64)[0]))
    return out


def text_fingerprint(text: bytes, shingle: int, lanes: int) -> list[int]:
    """The lanes of a fingerprint of a text's word shingles, repeats included."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # of bytes: A-Z alone, and white space 0x09-0x0D and 0x20
    if not words:
        return [0] * lanes
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    parts = [joined[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    return _lanes(np, np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts)), None, lanes)


def word_fingerprint(text: bytes, lanes: int) -> list[int]:
    """The lanes of a fingerprint of a text's words, each weighing 1 + ln(its count), in sixteenths."""
    from collections import Counter

    import numpy as np
    import xxhash

    counts = Counter(text.lower().split())
    if not counts:
        return [0] * lanes
    weights = np.rint(16 * (1 + np.log(np.fromiter(counts.values(), float, len(counts))))).astype(np.int64)
    return _lanes(np, np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in counts), np.uint64, len(counts)), weights, lanes)


def fingerprints(df: DataFrame, shingle: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, lanes array<long>) for every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [text_fingerprint(t or b"", shingle, lanes) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int64()))], ["doc_id", "lanes"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, lanes array<long>")


def _byte(c, k: int):
    return F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255))


def similar_pairs(stage: Stage, prints: DataFrame, radius: int, posting: int) -> DataFrame:
    """Edges (a, b) between fingerprints of (lane, fp), enough to connect all that link within a lane."""
    if radius != 2:
        raise ValueError("the exact way for long postings is built for radius 2")
    least = 8 - radius
    blocks = [(0, 1), (2, 3), (4, 5), (6, 7)]  # two differing bits touch two of them at most
    keys = []
    for k, pair in enumerate(combinations(range(len(blocks)), 2)):
        own = [i for p in pair for i in blocks[p]]
        value = sum((F.shiftleft(_byte(F.col("fp"), i), 8 * j) for j, i in enumerate(own)), F.lit(0).cast("long"))
        keys.append(F.struct(F.lit(k).alias("k"), value.alias("v")))
    index = prints.select("lane", "fp", F.explode(F.array(*keys)).alias("key")).select("lane", "key.k", "key.v", "fp")
    key = ["lane", "k", "v"]
    sizes = index.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    index = stage.put(index.join(sizes, key))

    short = index.where(F.col("n") <= posting)
    a, b = short.select(*key, F.col("fp").alias("a")), short.select(*key, F.col("fp").alias("b"))
    shared = sum(((_byte(F.col("a"), i) == _byte(F.col("b"), i)).cast("int") for i in range(8)), F.lit(0))
    pairs = a.join(b, key).where(F.col("a") < F.col("b")).where(shared >= least)
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("lane", "a", "b").distinct()

    long = index.where(F.col("n") > posting).select("lane", "fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    around = long.select("lane", "fp", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("fp")))).alias("centre"))
    low = around.groupBy("lane", "centre").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = around.join(low, ["lane", "centre"]).where("fp <> a").select("lane", "a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def near_duplicates(df: DataFrame, shingle: int = 3, lanes: int = 1, radius: int = 2, posting: int = 16) -> DataFrame:
    """doc_id, lanes (array<long>), component_id for every row of (doc_id, text).

    Texts link if any of their lanes differ in ``radius`` bits or fewer; component_id is the smallest
    doc_id that links reach. Further ``lanes`` hash the same shingles anew, so that fewer near copies
    are missed.

    Null, empty or blank text: fingerprint zero, linked like any other. Fewer words than a shingle:
    the whole sequence. Null doc_id: takes part, but never names a component unless it holds no
    other (then null). Repeated rows: same component. Empty input: no rows. Other columns are ignored.
    """
    stage = Stage(df.sparkSession, "simhash")
    unit = F.element_at("lanes", 1) if lanes == 1 else F.xxhash64("lanes")
    docs = stage.put(fingerprints(df, shingle, lanes).withColumn("unit", unit))
    units = docs.groupBy("unit").agg(F.min("doc_id").alias("low"), F.first("lanes").alias("lanes"))
    flat = units.select("unit", F.posexplode("lanes").alias("lane", "fp"))
    if lanes == 1:
        edges = similar_pairs(stage, flat.select("lane", "fp"), radius, posting).select("a", "b")
    else:
        flat = stage.put(flat)
        named = stage.put(flat.groupBy("lane", "fp").agg(F.min("unit").alias("name")))
        close = similar_pairs(stage, named.select("lane", "fp"), radius, posting)
        of = lambda c: named.select("lane", F.col("fp").alias(c), F.col("name").alias(f"{c}_unit"))
        close = close.join(of("a"), ["lane", "a"]).join(of("b"), ["lane", "b"]).select(F.col("a_unit").alias("a"), F.col("b_unit").alias("b"))
        equal = flat.join(named, ["lane", "fp"]).where("unit <> name").select(F.col("name").alias("a"), F.col("unit").alias("b"))
        edges = close.unionByName(equal)
    found = connected_components(stage, edges)
    units = units.select("unit", "low").join(found.withColumnRenamed("node", "unit"), "unit", "left")
    units = stage.put(units.withColumn("component", F.coalesce("component", "unit")))
    stage.keep_only(docs, units)
    lows = units.groupBy("component").agg(F.min("low").alias("component_id"))
    units = spread_join(units, lows, ["component"], F.col("unit")).select("unit", "component_id")
    # a text that a third of all rows hold: its rows are dealt over several tasks
    return spread_join(docs, units, ["unit"], F.col("doc_id"), how="inner").select("doc_id", "lanes", "component_id")


#: Sets of four byte positions of which any five positions hold one: those whose numbers' exclusive or is zero.
FOURS = [t for t in combinations(range(8), 4) if t[0] ^ t[1] ^ t[2] ^ t[3] == 0]
#: Members that each posting compares all others with in the first round.
PIVOTS = 3


def near_copies(df: DataFrame, shingle: int = 5, lanes: int = 10) -> DataFrame:
    """doc_id, component_id for every row of (doc_id, text): texts link at Jaccard similarity 4/5 of their five-word shingles.

    Candidates come from fingerprints of a text's words, in ``lanes`` independent hashings: texts of that
    similarity differ there in some 5 of 64 bits (fingerprints of the shingles themselves would in 9, which
    few bytes survive). Postings are keyed by four byte positions and their values; a pair that meets there
    is kept if the positional bytes that it shares reach five, the guaranteed minimum at three differing
    bits, and if the signatures of the sets of shingles allow the similarity; it is verified on the sets.
    A family of near copies isn't paired up: a first round compares a posting's members with ``PIVOTS`` of
    them, a second one only members that aren't connected yet.

    component_id is the smallest doc_id that links reach. Null, empty or blank texts are one group; fewer
    words than a shingle are one shingle. Null doc_ids, repeated rows and other columns as in
    ``near_duplicates``. Texts are told apart by 64-bit hashes. Empty input: no rows.
    """
    stage = Stage(df.sparkSession, "copies")
    text = F.coalesce("text", F.lit(""))
    text = F.when(text.rlike(r"^[\x09-\x0D\x20]*\z"), "").otherwise(text)
    docs = df.select("doc_id", F.xxhash64(text).alias("tid"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            texts, sets = b.column(1).to_pylist(), []
            for t in texts:
                s = shingles(t, shingle)
                sets.append((len(s), signature(np, s)))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([word_fingerprint(t, lanes) for t in texts], longs), pa.array([n for n, _ in sets], pa.int32()), pa.array([x for _, x in sets], longs)], ["tid", "lanes", "n", "signature"])

    units = docs.select("tid", "text").mapInArrow(run, "tid long, lanes array<long>, n int, signature array<long>")
    units = stage.put(units.dropDuplicates(["tid"]))

    # one number a key: lane, positions, their four bytes
    key = lambda t, lane, k: (lane.cast("long") * len(FOURS) + k) * F.lit(1 << 32) + sum((F.shiftleft(_byte(F.col("fp"), i), 8 * j) for j, i in enumerate(t)), F.lit(0).cast("long"))
    flat = units.where("n > 0").select("tid", F.posexplode("lanes").alias("lane", "fp"))
    posted = flat.select("tid", F.explode(F.array(*[key(t, F.col("lane"), k) for k, t in enumerate(FOURS)])).alias("key"))
    sizes = stage.put(posted.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    index = stage.put(posted.join(sizes, "key"))
    lane = F.element_at("lanes", F.floor(F.col("key") / F.lit(len(FOURS) << 32)).cast("int") + 1)
    index = stage.put(index.join(units, "tid").select("key", "tid", lane.alias("fp"), "n", "signature").withColumn("c", F.col("tid")))

    # both sides' bytes and signatures take part in the joins, which so yield hardly more pairs than links
    shared = sum(((_byte(F.col("a.fp"), i) == _byte(F.col("b.fp"), i)).cast("int") for i in range(8)), F.lit(0))
    meets = (F.col("a.key") == F.col("b.key")) & (shared >= 5) & may_be_similar("a", "b")
    pair = [F.least("a.tid", "b.tid").alias("a"), F.greatest("a.tid", "b.tid").alias("b")]
    member = F.struct("tid", "fp", "n", "signature")
    pivots = index.groupBy("key").agg(*[F.min_by(member, F.xxhash64("tid", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)])
    pivots = stage.put(pivots.select("key", F.inline(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)])))))
    met = index.alias("a").join(pivots.alias("b"), meets & (F.col("a.tid") != F.col("b.tid"))).select(*pair)
    edges = similar(stage, met, docs.select("tid", "text"), shingle)
    found = stage.put(connected_components(stage, edges))
    # second round: of each posting, members of different components
    left = stage.put(index.drop("c").join(found.select(F.col("node").alias("tid"), "component"), "tid", "left").withColumn("c", F.coalesce("component", "tid")).drop("component"))
    mixed = stage.put(left.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("key"))
    left = stage.put(left.join(mixed, "key"))
    met = left.alias("a").join(left.alias("b"), meets & (F.col("a.tid") < F.col("b.tid")) & (F.col("a.c") != F.col("b.c"))).select(*pair)
    # of what the first round has connected, one edge a text goes on
    edges = found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(similar(stage, met, docs.select("tid", "text"), shingle))
    found = stage.put(connected_components(stage, edges))

    lows = docs.groupBy("tid").agg(F.min("doc_id").alias("low")).join(found.withColumnRenamed("node", "tid"), "tid", "left")
    lows = stage.put(lows.withColumn("component", F.coalesce("component", "tid")))
    stage.keep_only(lows)
    first = lows.groupBy("component").agg(F.min("low").alias("component_id"))
    lows = spread_join(lows, first, ["component"], F.col("tid")).select("tid", "component_id")
    return spread_join(docs.select("doc_id", "tid"), lows, ["tid"], F.col("doc_id"), how="inner").select("doc_id", "component_id")


def deduplicated(df: DataFrame, groups=near_duplicates, **options) -> DataFrame:
    """The rows of df, all columns, with one row left of each of ``groups``.

    The row with the smallest (doc_id, hash of text, hash of the row) stays, a null doc_id only where no
    other is; of fully repeated rows one stays. doc_id may be of any ordered type.
    """
    own = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.xxhash64(*df.columns).alias("r"))
    found = groups(df.select(own.alias("doc_id"), "text"), **options)
    stay = found.select(F.col("component_id").alias("_own")).distinct()
    return df.withColumn("_own", own).join(stay, "_own", "left_semi").dropDuplicates(["_own"]).select(*df.columns)
