"""Language-model scores from a weighted backoff automaton.

States are the root, one for each word and one for each pair of words that training has seen; a state
knows its continuations. One left-to-right traversal of a text carries the state: a word with an arc
out of the state adds the arc's log-probability; without one, the state's backoff weight is added and
the failure arc followed, from a pair to its second word and from there to the root, which has an arc
for every word. An arc leads to the pair that its last two words make, the root's arcs to a word. All
texts of a block are traversed at once, a word of each at a time. The model has order three,
P(w | h) = max(c(hw) - D, 0) / c(h) + D * types(h) / c(h) * P(w | h'), h' the history without its first
word: a proper distribution at each state, over the smoothed words P(w) = (c(w) + 1) / (N + V + 1).
With D = 1, what was seen once makes no arc.

No n-gram is dropped and no table of the corpus is held by a worker: texts are packed into blocks,
each block asks for the counts of its own distinct words, pairs and triples (partial sums of all its
texts, dealt over buckets by hash), and traverses its texts with the arcs that come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, crc_bucket
from .token_counts import worker_cache

END = b""  # no word is empty, so the end token can't clash with one
MULTIPLIER = 0x9E3779B97F4A7C15
#: Tokens and texts of a block, unless one text alone has more.
BLOCK_TOKENS, BLOCK_TEXTS = 750_000, 50_000
#: Words that make up this share of the tokens are written as two bytes: 62,500 at most, below RARE.
CODED, RARE = 1.6e-5, 65_535
LOW = (1 << 48) - 1


class Hashes(dict):
    """Token -> 64-bit hash, kept by the worker within a bound."""

    def __missing__(self, token: bytes) -> int:
        import xxhash

        if len(self) >= 300_000:
            self.clear()
        self[token] = h = xxhash.xxh64_intdigest(token)
        return h


def _mix(np, a, b):
    h = (a ^ (b * np.uint64(MULTIPLIER))) * np.uint64(0xD1342543DE82EF95)
    h ^= h >> np.uint64(32)
    h *= np.uint64(MULTIPLIER)
    return h ^ (h >> np.uint64(29))


def _planes(x) -> bytes:
    """Unsigned numbers as planes of bytes, which compress well."""
    return x.view("u1").reshape(-1, x.itemsize).T.tobytes()


def _from_planes(np, raw, dtype: str):
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def _six(np, x) -> bytes:
    """The low 48 bits of each number; the rest is said by its bucket."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(np, raw):
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _bucket(np, h, buckets: int):
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _find(np, table, x):
    """Places in a sorted table, -1 where it has no such number."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


class Writer:
    """Arrays of a row, one after the other; symbols are words, by code if they have one or else by hash."""

    def __init__(self, np, hashes, codes):
        self.np, self.hashes, self.codes, self.parts = np, hashes, codes, []

    def symbols(self, words) -> None:
        codes = self.codes[words]
        self.parts += [_planes(self.np.where(codes < 0, RARE, codes).astype(self.np.uint16)), _six(self.np, self.hashes[words[codes < 0]])]

    def numbers(self, x) -> None:
        self.parts.append(_planes(x.astype(self.np.uint32)))

    def data(self) -> tuple[int, bytes]:
        raw = b"".join(self.parts)
        return len(raw), pa.Codec("zstd").compress(raw, asbytes=True)


class Reader:
    """What a Writer wrote; symbols come back as the low 48 bits of their hashes."""

    def __init__(self, np, size: int, data: bytes, coded):
        self.np, self.coded, self.at = np, coded, 0
        self.raw = memoryview(pa.Codec("zstd").decompress(data, size, asbytes=True)) if size else memoryview(b"")

    def take(self, n: int):
        self.at += n
        return self.raw[self.at - n : self.at]

    def hashes(self, n: int):
        return _from_six(self.np, self.take(6 * n))

    def numbers(self, n: int):
        return _from_planes(self.np, self.take(4 * n), "<u4")

    def symbols(self, n: int):
        np = self.np
        codes = _from_planes(np, self.take(2 * n), "<u2")
        rare, out = codes == RARE, np.empty(n, np.uint64)
        out[rare] = self.hashes(int(rare.sum()))
        out[~rare] = self.coded[codes[~rare]] & np.uint64(LOW)
        return out


class Block:
    """The words, pairs and triples of a block, and where each is counted.

    Ids of words are in order of frequency; pairs are in order of (first, second), triples of (pair, third). Pairs are
    counted beside their first word and triples beside their pair, but for heavy states, whose arcs are dealt
    over all buckets ("spread").
    """

    def __init__(self, np, sizes, train, hashes, ids, tables, buckets: int):
        coded, heavy, heavy_pairs = tables
        self.hashes, self.ids, self.buckets = hashes, ids, buckets
        n = len(hashes)
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        self.taught = np.repeat(train, sizes)
        self.end = int(np.flatnonzero(hashes == np.uint64(_end()))[0])  # the end token stands before the first word
        before = np.empty(len(ids), np.int64)
        before[1:] = ids[:-1]
        before[self.starts] = self.end
        self.pairs, self.pair_of = np.unique(before * n + ids, return_inverse=True)
        del before
        self.first, self.second = self.pairs // n, self.pairs % n
        self.later = np.ones(len(ids), bool)  # a first word has no pair before it
        self.later[self.starts] = False
        after = np.flatnonzero(self.later)
        triples, place, self.triple_of = np.unique(self.pair_of[after - 1] * n + ids[after], return_index=True, return_inverse=True)
        self.history, self.third, self.leads = triples // n, triples % n, self.pair_of[after[place]]
        self.codes = _find(np, coded, hashes)
        self.heavy = _find(np, heavy, hashes)
        pair_hash = _mix(np, hashes[self.first], hashes[self.second])
        self.heavy_pair = _find(np, heavy_pairs, pair_hash)
        spread = self.heavy[self.first] >= 0
        own = _bucket(np, hashes, buckets)
        bucket = np.where(spread, _bucket(np, pair_hash, buckets), own[self.first])
        # of each bucket: words, pairs whose first word lies there, spread pairs, triples of both, spread triples
        self.words_in = self._dealt(np, own, buckets)
        self.pairs_in = self._dealt(np, np.where(spread, buckets, bucket), buckets)
        self.spread_in = self._dealt(np, np.where(spread, bucket, buckets), buckets)
        hot = self.heavy_pair[self.history] >= 0
        self.triples_in = self._dealt(np, np.where(hot, buckets, bucket[self.history]), buckets, second=spread[self.history])
        self.hot_in = self._dealt(np, np.where(hot, _bucket(np, _mix(np, pair_hash[self.history], hashes[self.third]), buckets), buckets), buckets)

    @staticmethod
    def _dealt(np, bucket, buckets: int, second=None):
        order = np.argsort(bucket if second is None else 2 * bucket + second, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))

    def of(self, b: int):
        """Words, pairs, spread pairs, triples and spread triples of bucket b."""
        return tuple(x[at[b] : at[b + 1]] for x, at in (self.words_in, self.pairs_in, self.spread_in, self.triples_in, self.hot_in))

    def asked(self, np) -> Iterator[tuple]:
        """(bucket, words, pairs, spread pairs, triples, spread triples, size, data) for each bucket that counts something of the block."""
        n_word = np.bincount(self.ids[self.taught], minlength=len(self.hashes))
        n_pair = np.bincount(self.pair_of[self.taught], minlength=len(self.pairs))
        n_triple = np.bincount(self.triple_of[self.taught[self.later]], minlength=len(self.third))
        follow = np.bincount(self.first, minlength=len(self.hashes))
        follow[self.heavy >= 0] = 0
        follow_pair = np.bincount(self.history, minlength=len(self.pairs))
        follow_pair[self.heavy_pair >= 0] = 0
        for b in range(self.buckets):
            w, p, q, t, z = self.of(b)
            if len(w) or len(p) or len(q) or len(t) or len(z):
                out = Writer(np, self.hashes, self.codes)
                out.parts.append(_six(np, self.hashes[w]))
                out.numbers(n_word[w])
                out.numbers(follow[w])
                for x in (p, q):
                    out.symbols(self.second[x])
                    out.numbers(n_pair[x])
                    out.numbers(follow_pair[x])
                out.numbers(self.heavy[self.first[q]])
                for x in (t, z):
                    out.symbols(self.third[x])
                    out.numbers(n_triple[x])
                out.numbers(self.heavy_pair[self.history[z]])
                yield b, len(w), len(p), len(q), len(t), len(z), *out.data()

    def scores(self, np, answers, heavy_types, total: int, distinct: int, discount: float):
        """(known words, base score, score) of each text, from (bucket, data) rows; heavy_types: of heavy words and of heavy pairs."""
        c, types = np.zeros(len(self.hashes)), np.zeros(len(self.hashes))
        pairs, pair_types, triples = np.zeros(len(self.pairs)), np.zeros(len(self.pairs)), np.zeros(len(self.third))
        for b, data in answers:
            w, p, q, t, z = self.of(b)
            size = 8 * (2 * (len(w) + len(p) + len(q)) + len(t) + len(z))
            got, at = _from_planes(np, pa.Codec("zstd").decompress(data, size, asbytes=True), "<u8"), 0
            for out, x in ((c, w), (types, w), (pairs, p), (pairs, q), (pair_types, p), (pair_types, q), (triples, t), (triples, z)):
                out[x] = got[at : at + len(x)]
                at += len(x)
        for out, place, known in ((types, self.heavy, heavy_types[0]), (pair_types, self.heavy_pair, heavy_types[1])):
            out[place >= 0] = known[place[place >= 0]]
        word = (c + 1) / (total + distinct + 1)
        for name in ("words_in", "pairs_in", "spread_in", "triples_in", "hot_in", "triple_of", "taught", "later", "heavy_pair"):  # what counting alone needs
            delattr(self, name)
        automaton = Automaton(np, word, (c, types), (self.first, self.second, pairs, pair_types), (self.history, self.third, triples, self.leads), discount)
        at = self.starts
        return np.add.reduceat((c > 0)[self.ids].astype(np.int64), at), np.add.reduceat(np.log10(word)[self.ids], at), automaton.traverse(np, self.ids, self.pair_of, at, self.end)


class Automaton:
    """States 0 to n - 1 for a block's words, n for the root, n + 1 + j for its pair j; what was never seen is the state that it fails to.

    words: their counts and types; pairs: (first, second, counts, types), in order of (first, second); triples:
    (pair, third, counts, the pair of its last two words), in order of (pair, third). ``arcs``: keys
    state * n + word, in order, with ``weights`` (log10) and the state that each ``leads`` to; ``fail`` and
    ``failure``: weight and target of each state's failure arc; ``root``: the root's arcs, one for each word,
    which lead to ``then``; ``entry``: the state after a pair.
    """

    def __init__(self, np, word, words, pairs, triples, discount: float):
        (c, types), (first, second, n_pair, pair_types), (history, third, n_triple, last) = words, pairs, triples
        n, m = len(c), len(n_pair)
        self.n, self.root = n, np.log10(word)
        self.then = np.where(c > 0, np.arange(n), n)
        left = discount * types / np.maximum(c, 1)
        along = np.maximum(n_pair - discount, 0) / np.maximum(c[first], 1) + np.where(c[first] > 0, left[first], 1.0) * word[second]  # P(second | first)
        arc = (c[first] > 0) & (n_pair > discount)
        self.entry = np.where(arc, np.arange(n + 1, n + 1 + m), self.then[second])
        pair_left = discount * pair_types / np.maximum(n_pair, 1)
        # P(third | second), by the pair of the last two words
        far = (n_pair[history] > discount) & (n_triple > discount)
        history, third, n_triple, last = history[far], third[far], n_triple[far], last[far]
        weight = (n_triple - discount) / n_pair[history] + pair_left[history] * along[last]
        # and one key beyond all, at which every search ends
        self.arcs = np.concatenate((first[arc] * n + second[arc], (history + n + 1) * n + third, [np.iinfo(np.int64).max]))
        self.weights = np.log10(np.concatenate((along[arc], weight, [1.0])))
        self.leads = np.concatenate((np.flatnonzero(arc) + n + 1, self.entry[last], [n]))
        with np.errstate(divide="ignore"):  # without a discount nothing is left for words without an arc
            self.fail = np.concatenate((np.log10(np.where(c > 0, left, 1.0)), [0.0], np.log10(np.where(n_pair > 0, pair_left, 1.0))))
        self.failure = np.concatenate((np.full(n + 1, n), self.then[second]))

    def step(self, np, state, word):
        """(log10 weight, next state) of a word in a state: along its arc, or else along failure arcs to the first state that has one."""
        weight, after, open_ = np.zeros(len(word)), self.then[word], np.ones(len(word), bool)
        for _ in range(2):
            key = state * self.n + word
            at = np.searchsorted(self.arcs, key)
            arc = open_ & (self.arcs[at] == key)
            weight += np.where(arc, self.weights[at], np.where(open_, self.fail[state], 0.0))
            after = np.where(arc, self.leads[at], after)
            open_ &= ~arc
            state = self.failure[state]
        return weight + np.where(open_, self.root[word], 0.0), after

    def traverse(self, np, ids, pair_of, starts, end: int, lane: int = 2048):
        """The sum of each text's weights; texts begin in the state of the end token.

        Texts of more than ``lane`` words go on in several lanes, each from the state that the words before it
        lead to, so that a block has no more steps than that.
        """
        sizes = np.diff(np.append(starts, len(ids)))
        number = -(-sizes // lane)
        text = np.repeat(np.arange(len(starts)), number)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
        begin = starts[text] + nth * lane
        length = np.minimum(sizes[text] - nth * lane, lane)
        state = np.where(nth == 0, self.then[end], self.entry[pair_of[np.maximum(begin - 1, 0)]])
        order = np.argsort(-length, kind="stable")
        begin, length, state, total = begin[order], length[order], state[order], np.zeros(len(order))
        active = np.searchsorted(-length, -np.arange(lane), side="left")  # lanes with more than so many words
        for k in range(int(length[0])):
            m = active[k]
            weight, state[:m] = self.step(np, state[:m], ids[begin[:m] + k])
            total[:m] += weight
        return np.bincount(text[order], total, len(starts))


def _end() -> int:
    import xxhash

    return xxhash.xxh64_intdigest(END)


def _count(np, rows, tables):
    """Answers to the (words, pairs, spread pairs, triples, spread triples, size, data) rows of a bucket.

    Beside them (words in all, distinct words, types of heavy words and then of heavy pairs).
    """
    coded, heavy, heavy_pairs = tables
    lists = [[] for _ in range(15)]
    for u, p, q, t, z, size, data in rows:
        r = Reader(np, size, data, coded)
        got = [r.hashes(u), r.numbers(u), r.numbers(u)]
        for k in (p, q):
            got += [r.symbols(k), r.numbers(k), r.numbers(k)]
        got.append(r.numbers(q))
        for k in (t, z):
            got += [r.symbols(k), r.numbers(k)]
        got.append(r.numbers(z))
        for out, x in zip(lists, got):
            out.append(x)
    follow_p, follow_q = lists[5], lists[8]
    words, n_word, follow, second, n_pair, _, other, n_spread, _, first_q, third, n_triple, hot, n_hot, first_z = (np.concatenate(x) for x in lists[:15])
    del lists

    def totals(key, n):
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        return first, of, np.bincount(of, n, len(first)).astype(np.uint64)

    def mixed(a, b):
        return _mix(np, a.astype(np.uint64), b)

    _, of_word, c = totals(words, n_word)
    before = np.repeat(of_word, follow)
    first, of_pair, arcs = totals(mixed(before, second), n_pair)
    types = np.bincount(before[first[arcs > 0]], minlength=len(c)).astype(np.uint64)
    first, of_spread, spread = totals(mixed(first_q, other), n_spread)
    heavy_types = [np.bincount(first_q[first[spread > 0]], minlength=len(heavy))]
    history, d, e, b = [], 0, 0, len(arcs)
    for (_, p, q, *_), f, g in zip(rows, follow_p, follow_q):
        history += [np.repeat(of_pair[d : d + p], f), np.repeat(of_spread[e : e + q] + b, g)]
        d, e = d + p, e + q
    history = np.concatenate(history)
    first, of_triple, triples = totals(mixed(history, third), n_triple)
    pair_types = np.bincount(history[first[triples > 0]], minlength=b + len(spread)).astype(np.uint64)
    first, of_hot, hots = totals(mixed(first_z, hot), n_hot)
    heavy_types.append(np.bincount(first_z[first[hots > 0]], minlength=len(heavy_pairs)))
    out, at = [], [0] * 5
    for u, p, q, t, z, *_ in rows:
        w, x, y, tri, h = (of[i : i + k] for of, i, k in zip((of_word, of_pair, of_spread, of_triple, of_hot), at, (u, p, q, t, z)))
        answer = np.concatenate((c[w], types[w], arcs[x], spread[y], pair_types[x], pair_types[y + b], triples[tri], hots[h]))
        out.append(pa.Codec("zstd").compress(_planes(answer), asbytes=True))
        at = [i + k for i, k in zip(at, (u, p, q, t, z))]
    return out, (int(c.sum()), int((c > 0).sum()), np.concatenate(heavy_types))


def _unpacked(np, row):
    """(sizes, train, hashes, ids) of a block's row."""
    data = pa.Codec("zstd").decompress(row["data"], row["bytes"], asbytes=True)
    hashes = np.frombuffer(data, np.uint64, row["words"])
    ids = _from_planes(np, data[8 * row["words"] :], "<u4").astype(np.int64)
    return np.array(row["sizes"], np.int64), ~np.array(row["held_out"], bool), hashes, ids


def score_texts(df: DataFrame, discount: float = 1.0, folds: int = 7, held: int = 2, heavy_share: float = 1e-4, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of (doc_id, text).

    Texts whose crc32(doc_id as text) mod ``folds`` is ``held`` are held out of training. base_score:
    add-one words; score: the automaton's log10 probability, over all words, pairs and triples of the training
    texts. Words are told apart by 64-bit hashes. ``heavy_share``: what follows a word or a pair that may make
    up as much of the tokens is dealt over all buckets; it decides about tasks, not about results.

    Null text counts as empty (the end token alone). Null doc_id: crc32 of the empty text. Repeated
    rows count and are scored each. No training rows: N = V = 0, and every token is unknown. Empty
    input: no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    stage = Stage(spark, "ngram")
    kind = df.schema["doc_id"].dataType.simpleString()
    docs = df.select("doc_id", (crc_bucket(F.col("doc_id"), folds) == held).alias("held_out"), F.col("text").cast("binary").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        get, end = worker_cache("hashes").setdefault("of", Hashes()).__getitem__, _end()
        docs, flags, sizes, flat = [], [], [], []
        tokens = 0

        def block(id_type) -> pa.RecordBatch:
            nonlocal docs, flags, sizes, flat, tokens, number
            all_hashes = np.concatenate(flat)
            taught = np.repeat(~np.array(flags), sizes)
            hashes, ids, counts = np.unique(all_hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            times = np.bincount(ids[taught], minlength=len(hashes))
            often = np.flatnonzero(times >= max(1, min(CODED, heavy_share) / 2 * taught.sum()))
            before = np.empty_like(all_hashes)
            before[1:] = all_hashes[:-1]
            before[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = end
            pairs, seen = np.unique(_mix(np, before, all_hashes)[taught], return_counts=True)
            hot = seen >= max(1, heavy_share / 2 * taught.sum())
            data = hashes[order].tobytes() + _planes(rank[ids])
            longs = pa.list_(pa.int64())
            row = [pa.array([number], pa.int64()), pa.array([docs], pa.list_(id_type)), pa.array([flags], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32())), pa.array([len(hashes)], pa.int32()), pa.array([len(data)], pa.int64())]
            row += [pa.array([pa.Codec("zstd").compress(data, asbytes=True)], pa.binary()), pa.array([int(taught.sum())], pa.int64()), pa.array([hashes[often].view(np.int64)], longs), pa.array([times[often]], longs), pa.array([pairs[hot].view(np.int64)], longs), pa.array([seen[hot]], longs)]
            number += 1
            docs, flags, sizes, flat, tokens = [], [], [], [], 0
            return pa.RecordBatch.from_arrays(row, ["block", "docs", "held_out", "sizes", "words", "bytes", "data", "taught", "often", "times", "pairs", "seen"])

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            for i, out, text in zip(*(c.to_pylist() for c in b.columns)):
                words = text.lower().split() if text else []  # of bytes: A-Z alone, and white space 0x09-0x0D and 0x20
                flat.append(np.fromiter(map(get, words), np.uint64, len(words)))
                flat.append(np.array([end], np.uint64))
                docs.append(i)
                flags.append(out)
                sizes.append(len(words) + 1)
                tokens += len(words) + 1
                if tokens >= block_tokens or len(docs) >= BLOCK_TEXTS:
                    yield block(id_type)
        if docs:
            yield block(id_type)

    packed = docs.mapInArrow(pack, f"block long, docs array<{kind}>, held_out array<boolean>, sizes array<int>, words int, bytes long, data binary, taught long, often array<long>, times array<long>, pairs array<long>, seen array<long>")
    blocks = stage.put(packed)
    total, number = blocks.agg(F.coalesce(F.sum("taught"), F.lit(0)), F.count("*")).first()
    # only what makes up the share of a block, halved, is listed; so at most 1/share words or pairs of the corpus come back

    def frequent(keys: str, counts: str, share: float) -> list[tuple[int, int]]:
        n = blocks.select(F.inline(F.arrays_zip(keys, counts))).groupBy(keys).agg(F.sum(counts).alias("n"))
        return [(r[0] & (2**64 - 1), r[1]) for r in n.where(F.col("n") >= F.lit(share * total)).collect()]

    words = frequent("often", "times", min(CODED, heavy_share))
    of = lambda rows, share: sorted(h for h, n in rows if n >= share * total)
    lists = of(words, CODED), of(words, heavy_share), of(frequent("pairs", "seen", heavy_share), heavy_share)
    shared = spark.sparkContext.broadcast(lists)
    buckets, n_heavy, n_types = max(1, number), len(lists[1]), len(lists[1]) + len(lists[2])

    def tables(np):
        return tuple(np.array(x, np.uint64) for x in shared.value)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for row in b.to_pylist():
                own = Block(np, *_unpacked(np, row), tables(np), buckets)
                rows = list(zip(*own.asked(np)))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array([row["block"]] * len(rows[0]), pa.int64()), *(pa.array(x, pa.int32()) for x in rows[1:7]), pa.array(rows[7], pa.binary())], ["bucket", "block", "u", "p", "q", "t", "z", "size", "data"])

    def count(table: pa.Table) -> pa.Table:
        import numpy as np

        rows = table.to_pydict()
        answers, (n, v, types) = _count(np, list(zip(*(rows[x] for x in ("u", "p", "q", "t", "z", "size", "data")))), tables(np))
        k, longs = len(answers), pa.list_(pa.int64())
        once = lambda x: pa.array([x] + [None] * (k - 1), longs if isinstance(x, list) else pa.int64())
        return pa.Table.from_arrays([pa.array(rows["block"], pa.int64()), pa.array(rows["bucket"], pa.int32()), pa.array(answers, pa.binary()), once(v), once(types.tolist())], ["block", "bucket", "data", "v", "types"])

    asked = blocks.select("block", "docs", "held_out", "sizes", "words", "bytes", "data").mapInArrow(ask, "bucket int, block long, u int, p int, q int, t int, z int, size int, data binary")
    answers = stage.put(asked.groupBy("bucket").applyInArrow(count, "block long, bucket int, data binary, v long, types array<long>"))
    distinct = answers.agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]
    found = answers.where("types is not null").select(F.posexplode("types").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
    types = [0] * n_types
    for r in found:
        types[r.i] = r.n
    types_of_heavy = spark.sparkContext.broadcast(types)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def traverse(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        row, got = left.to_pylist()[0], right.to_pydict()
        sizes, train, hashes, ids = _unpacked(np, row)
        own = Block(np, sizes, train, hashes, ids, tables(np), buckets)
        known_types = np.array(types_of_heavy.value, float)
        known, base, score = own.scores(np, zip(got["bucket"], got["data"]), (known_types[:n_heavy], known_types[n_heavy:]), total, distinct, discount)
        docs = left.column("docs").combine_chunks().flatten()
        return pa.Table.from_arrays([docs, pa.array(row["held_out"], pa.bool_()), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score)], names)

    rows = blocks.select("block", "docs", "held_out", "sizes", "words", "bytes", "data").groupBy("block").cogroup(answers.select("block", "bucket", "data").groupBy("block"))
    out = rows.applyInArrow(traverse, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
