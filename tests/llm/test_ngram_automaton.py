import math
import re
import zlib
from collections import Counter

import pytest

from textloom.llm.ngram_automaton import score_texts

SCHEMA = "doc_id long, text string, score double"


def brute(rows, discount=1.0, folds=7, held=2):
    """The same model by direct recursion over counts of words, pairs and triples."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    toks = [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", low(t)) if w] + [""]) for i, t in rows]
    out_of = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % folds == held
    c = Counter(w for i, t in toks if not out_of(i) for w in t)
    total, distinct = sum(c.values()), len(c)
    two = Counter(p for i, t in toks if not out_of(i) for p in zip(["", *t], t))
    three = Counter(p for i, t in toks if not out_of(i) for p in zip(["", *t], t, t[1:]))
    seen, context, types = Counter(), Counter(), Counter()
    for (*h, w), n in [*two.items(), *three.items()]:
        seen[*h, w] = n
        context[tuple(h)] += n
        types[tuple(h)] += 1

    def p(h, w):
        if not h:
            return (c[w] + 1) / (total + distinct + 1)
        less = p(h[1:], w)
        return max(seen[*h, w] - discount, 0) / context[h] + discount * types[h] / context[h] * less if context[h] else less

    def unseen(h):
        return discount * types[h] / context[h] * unseen(h[1:]) if h else 1 / (total + distinct + 1)

    some = [h for h in context if len(h) == 1 or context[h[1:]]]
    assert all(math.isclose(sum(p(h, w) for w in c) + unseen(h), 1) for h in [*some[:4], *some[-4:]])
    got = []
    for i, t in toks:
        lp = math.log10(p(("",), t[0])) + sum(math.log10(p((a, b), w)) for a, b, w in zip(["", *t], t, t[1:]))
        got.append((i, out_of(i), len(t), sum(1 for w in t if c[w]), total, sum(math.log10(p((), w)) for w in t), lp))
    return got


def check(spark, rows, **options):
    want = brute(rows, options.get("discount", 1.0))
    got = [tuple(r) for r in score_texts(spark.createDataFrame([(i, t, 0.0) for i, t in rows], SCHEMA), **options).collect()]
    order = lambda rs: sorted(rs, key=lambda r: (*map(repr, r[:5]), round(r[5], 6), round(r[6], 6)))
    assert len(got) == len(want)
    for a, b in zip(order(got), order(want)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9), (a, b)


def texts_of(n=40):
    texts = ["The cat sat on the mat", "the cat sat", "the  cat\tran on the mat", "", None, "É the É", "on the mat the cat sat on the mat"]
    return [(i, texts[i % len(texts)]) for i in range(n)] + [(None, "the cat"), (None, "the cat"), (50, "unseen words only"), (51, "x " * 500)]


@pytest.mark.parametrize("options", [{}, {"discount": 0.75}, {"block_tokens": 30}, {"block_tokens": 30, "heavy_share": 0.04}, {"block_tokens": 1, "heavy_share": 2.0}])
def test_matches_direct_recursion(spark, options):
    check(spark, texts_of(), **options)


def test_matches_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows, block_tokens=9_000)


def test_rare_pairs_count_in_a_large_table(spark):
    """Over half a million training tokens, pairs and triples of two occurrences still make arcs."""
    d = "/root/testdata/sf0.1/documents.parquet"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(d).where("doc_id % 4 = 0").select("doc_id", "text").collect()]
    rows += [(10**6 + k, " ".join(f"rare{j}" for j in range(60))) for k in range(2)] + [(10**6 + 10, " ".join(f"lone{j}" for j in range(60)))]
    assert not any(zlib.crc32(str(10**6 + k).encode()) % 7 == 2 for k in (0, 1, 10))
    check(spark, rows, block_tokens=200_000)
    got = {r.doc_id: r.score / r.n_tokens for r in score_texts(spark.createDataFrame([(i, t, 0.0) for i, t in rows], SCHEMA)).where("doc_id >= 1000000").collect()}
    assert got[10**6] == got[10**6 + 1] > got[10**6 + 10] + 3


def test_empty_and_untrained(spark):
    assert score_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = score_texts(spark.createDataFrame([(only, "a b", 0.0)], SCHEMA)).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)


def test_a_pair_that_holds_most_tokens(spark):
    """Continuations of one pair are dealt over buckets and still counted whole."""
    rows = [(k, " ".join(f"of the w{k % 7}{j}" for j in range(60))) for k in range(30)]
    for options in ({"block_tokens": 500}, {"block_tokens": 500, "heavy_share": 0.2}, {"block_tokens": 500, "heavy_share": 2.0}):
        check(spark, rows, **options)


@pytest.mark.parametrize("discount", [1.0, 0.75, 0.0])
def test_traversal_follows_arcs_and_failures(discount):
    """Sums of a traversal, in lanes of any length, are those of walking word by word."""
    import numpy as np

    from textloom.llm.ngram_automaton import Automaton

    rng = np.random.default_rng(2)
    n, sizes = 9, np.array([1, 7, 0, 23, 4, 1]) + 1
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    ids = rng.integers(1, 5, sizes.sum())
    ids[starts + sizes - 1] = 0  # the end token
    texts = [ids[a : a + k].tolist() for a, k in zip(starts, sizes)]
    taught = texts[:4]  # words 5 to 8 are never seen
    texts[4][1], ids[starts[4] + 1] = 7, 7
    one = Counter(w for t in taught for w in t)
    two, three = Counter(x for t in taught for x in zip([0, *t], t)), Counter(x for t in taught for x in zip([0, *t], t, t[1:]))
    c = np.array([one[w] for w in range(n)], float)
    word = (c + 1) / (c.sum() + 8)
    known = lambda h: [k for k in [*two.items(), *three.items()] if k[0][:-1] == h]

    def p(h, w):
        if not h:
            return word[w]
        own = dict(known(h))
        size, less = sum(own.values()), p(h[1:], w)
        return less if not size else max(own.get((*h, w), 0) - discount, 0) / size + discount * len(own) / size * less

    with np.errstate(divide="ignore"):
        walked = [np.log10(p((0,), t[0])) + sum(np.log10(p((a, b), w)) for a, b, w in zip([0, *t], t, t[1:])) for t in texts]
    before = np.concatenate([[0, *t[:-1]] for t in texts])
    pairs, pair_of = np.unique(before * n + ids, return_inverse=True)
    later = np.array([i for i in range(len(ids)) if i not in set(starts.tolist())])
    triples, place = np.unique(pair_of[later - 1] * n + ids[later], return_index=True)
    types = np.array([len(known((w,))) for w in range(n)], float)
    first, second = pairs // n, pairs % n
    of_pair = [(int(a), int(b)) for a, b in zip(first, second)]
    pair_counts, pair_types = np.array([two[x] for x in of_pair], float), np.array([len(known(x)) for x in of_pair], float)
    counts = np.array([three[*of_pair[t // n], t % n] for t in triples.tolist()], float)
    automaton = Automaton(np, word, (c, types), (first, second, pair_counts, pair_types), (triples // n, triples % n, counts, pair_of[later[place]]), discount)
    for lane in (1, 3, 2048):
        assert np.allclose(automaton.traverse(np, ids, pair_of, starts, 0, lane), walked)
