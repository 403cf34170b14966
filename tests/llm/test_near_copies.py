"""Near copies against the brute-force Jaccard similarity of all pairs."""

import random
from itertools import combinations

import corpus_pipeline
from textloom.llm.simhash_dedup import FOURS, deduplicated, near_copies


def grams(text):
    w = text.lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows):
    own = {i: grams(t or "") for i, t in rows}
    up = {i: i for i in own}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(own, 2):
        both = len(own[a] & own[b])
        if 5 * both >= 4 * (len(own[a]) + len(own[b]) - both):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: top(i) for i in own}


def variants(n=14):
    """Copies around 0.8: cut, appended to, reordered, scattered edits; and texts that share half."""
    rng, rows = random.Random(1), []
    for _ in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((60, 200, 900)))]
        size = len(base)
        made = [base, *(base[: int(size * x)] for x in (0.95, 0.9, 0.83, 0.79, 0.7)), *(base + [f"f{rng.random()}" for _ in range(int(size * x))] for x in (0.1, 0.2, 0.24, 0.3))]
        made += [base[size // 3 :] + base[: size // 3], [w if rng.random() > 0.02 else f"e{rng.random()}" for w in base], [w if rng.random() > 0.05 else f"e{rng.random()}" for w in base], base[: size // 2] + [f"h{rng.random()}" for _ in range(size // 2)]]
        rng.shuffle(made)
        rows += made[:9]
    texts = [*map(" ".join, rows), "", None, " \n", "a b", "A  b", "b a", "one two three four five", "one two three four five"]
    return list(enumerate(texts))


def links(rows, limit=4):
    """All pairs of similarity ``limit``/5 or more."""
    own = {i: grams(t or "") for i, t in rows}
    return [(a, b) for a, b in combinations(own, 2) if 5 * len(own[a] & own[b]) >= limit * len(own[a] | own[b])]


def test_every_five_positions_hold_a_four():
    assert len(FOURS) == 14 and all(any(set(t) <= set(f) for t in FOURS) for f in combinations(range(8), 5))


def linked(spark, rows):
    """(pairs of similarity 4/5 or more, those that end up together); nothing is linked that brute force doesn't connect."""
    want, pairs = brute(rows), links(rows)
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == want.keys() and all(want[i] == want[g] for i, g in got.items())
    blank = [i for i, t in rows if not (t or "").strip()]
    assert {got[i] for i in blank} == ({min(blank)} if blank else set())
    hit = sum(got[a] == got[b] for a, b in pairs)
    print("pairs", len(pairs), "linked", hit)
    return len(pairs), hit


def test_recall_of_made_copies(spark):
    """Copies of documents around 0.8: cut, extended by another text, reordered, edited all over."""
    texts = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars between 600 and 9000").orderBy("doc_id").limit(70).collect()]
    rng, rows = random.Random(2), []
    for base, other in zip(texts, texts[1:] + texts[:1]):
        n = len(base)
        edit = lambda p: [rng.choice(other) if rng.random() < p else w for w in base]  # noqa: E731, B023
        rows += [base, *(base[: int(n * x)] for x in (0.95, 0.88, 0.83, 0.79)), *(base + other[: int(n * x)] for x in (0.1, 0.18, 0.23)), base[n // 3 :] + base[: n // 3], edit(0.01), edit(0.02), edit(0.04)]
    pairs, hit = linked(spark, list(enumerate(map(" ".join, rows))))
    assert pairs > 1000 and hit >= 0.95 * pairs


def test_recall_of_random_words(spark):
    """The same on words drawn evenly, which share no frequent ones: the hardest for fingerprints."""
    pairs, hit = linked(spark, variants(40))
    assert pairs > 300 and hit >= 0.9 * pairs


def test_recall_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[i] == want[g] for i, g in got.items())
    assert len(rows) - len(set(got.values())) >= 0.95 * (len(rows) - len(set(want.values())))


def test_families_link_through_other_than_their_smallest(spark):
    base = [f"b{i}" for i in range(300)]
    chain = [base[i * 12 :] + [f"n{j}" for j in range(i * 12)] for i in range(12)]  # neighbours at 0.92, every third below 0.8
    rows = list(enumerate([*map(" ".join, chain), *(" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(0, 300, 10))]))
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_empty(spark):
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_kept_row_is_the_same_in_any_order(spark):
    rows = [(f"d{k % 2}", "same text of five words", f"s{k}") for k in range(6)] + [(None, "same text of five words", "s9")]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    kept = {tuple(tuple(r) for r in deduplicated(df.repartition(n), near_copies).collect()) for n in (1, 3, 7)}
    assert len(kept) == 1 and len(next(iter(kept))) == 1 and next(iter(kept))[0][0] == "d0"


def test_pipeline_takes_cut_and_extended_copies(spark):
    texts = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' and n_chars between 1500 and 4000").orderBy("doc_id").limit(21).collect()]
    made = []
    for w, other in zip(texts, texts[1:]):
        made += [w, w[: int(len(w) * 0.86)], w + other[: int(len(w) * 0.15)], w[: len(w) * 5 // 8] + other[: len(w) * 3 // 8]]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    want = brute(list(enumerate(map(" ".join, made))))
    assert {i for i, w in want.items() if i == w} <= kept and len(kept) - len(set(want.values())) <= 4
