"""Fill-in-middle, whitening and chat formats against brute force, and on odd rows."""

import hashlib
import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import chat_format, fill_in_middle, whitening

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill in the middle

ODD = [(None, None), (None, "a b"), (1, ""), (2, None), (3, " \t\n\r  "), (4, "x" * 30_000), (5, "é́ 日本 \U0001f600" * 50), (6, "has <P> inside"), (7, "<S"), (8, "<<P" * 9), (9, "same"), (9, "same"), (10, "<M>")]


def brute_fim(i, text):
    text = text or ""
    h = [int(sha(f"1:{'' if i is None else i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return i, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_fim_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = [*ODD, *docs, *[(100_000 + i, f"Text {i} of [many], <P, S>") for i in range(200)]]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, form string, output string, _units string")
    made = fill_in_middle.restored(fill_in_middle.fill_in_middle(df))
    got = [tuple(r) for r in made.collect()]
    want = [(*w, t or "") for w, (_, t) in zip((brute_fim(i, t) for i, t in rows), rows)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fim_empty_table(spark):
    assert fill_in_middle.restored(fill_in_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_fim_of_words_and_other_sentinels(spark):
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    texts = [f"some  words\tof {i} \n text " for i in range(60)] + ["", "a", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    made = fill_in_middle.restored(fill_in_middle.fill_in_middle(df, unit=r"\s*\S+|\s+$", sentinels=marks, plain_from=100), marks)
    rows = sorted(made.collect(), key=lambda r: r.doc_id)
    assert [r.restored for r in rows] == texts
    for r, t in zip(rows, texts):
        assert r.n == len(re.findall(r"\s*\S+|\s+$", t))
        assert r.form == "plain" if not t else r.form in ("psm", "spm") and r.prefix_chars + r.middle_chars <= len(t)
    # units that leave something out would lose it: such texts stay plain
    made = fill_in_middle.fill_in_middle(df, unit=r"\S+", plain_from=100)
    assert {r.form for r in made.collect() if r.doc_id < 60} == {"plain"}


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("<P>", "P", "<M>"), ("ab", "bc", "cd"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>")])
def test_sentinels_that_could_be_mistaken(marks):
    with pytest.raises(ValueError):
        fill_in_middle._checked(marks)


# ---- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows], "vec_id long, embedding array<float>, n string, whitened double")


def brute_whitening(v, k=8):
    x = np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) + 100_000
    n, total = len(x), x.sum(0)
    c = x - total / n
    cov = c.T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return (c @ u) / np.sqrt(e), e / np.trace(cov), [sum(int(d) ** 2 for d in n * r - total) for r in x]


@pytest.mark.parametrize("shape", [(200, 12), (60, 130), (3000, 3)])
def test_whitening_matches_eigenvectors(spark, shape):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=shape) * np.linspace(3, 0.5, shape[1]) + 0.3).astype(np.float32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(9001, None), (9002, [float("nan")] * shape[1]), (9003, [float("inf")] + [0.0] * (shape[1] - 1)), (9004, [None] * shape[1]), (9005, []), (9006, [1e30] * shape[1]), (9007, [0.1])]
    got = sorted(whitening.whiten(vectors(spark, rows + bad)).collect(), key=lambda r: r.vec_id)
    want, shares, deviations = brute_whitening(v)
    assert [r.vec_id for r in got] == list(range(shape[0])) and {r.n for r in got} == {shape[0]}
    own = np.array([r.whitened for r in got])
    signs = np.sign((own * want).sum(0))
    assert np.abs(own - want * signs).max() < 1e-9 and np.allclose(got[0].explained, shares, rtol=1e-9)
    assert [int(r.deviation) for r in got] == deviations
    error = np.abs(np.cov(own.T, bias=True) - np.eye(own.shape[1])).max()
    assert got[0].identity_error < 1e-9 and abs(got[0].identity_error - error) < 1e-12


def test_whitening_edges(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (None, [float("nan")])])).collect() == []
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.identity_error) for r in same] == [(3, 0, [], None)] * 3
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()  # one direction alone
    assert {len(r.whitened) for r in line} == {1} and math.isclose(line[0].explained[0], 1.0)
    # integers that leave 63 bits are summed exactly all the same
    wide = whitening.whiten(vectors(spark, [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [5e8, 2.0])])).collect()
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in ([1e9, 0.0], [-1e9, 1.0], [5e8, 2.0])]
    total = [sum(c) for c in zip(*x)]
    assert {r.vec_id: int(r.deviation) for r in wide} == {i + 1: sum((3 * c - s) ** 2 for c, s in zip(v, total)) for i, v in enumerate(x)}


def test_partial_sums_of_tasks(spark):
    df = spark.range(1000).selectExpr("array(cast(id as float), -1f) as v").repartition(7)
    assert whitening.sums_of(df, "v", 4, 1) == (1000, [4 * 499_500 + 1000, -3000])


# ---- chat formats

SAID = [
    "plain", "", "</s>[INST] ok [/INST]", r"<\s> and <\\s> [\INST] <s", "[ROLE]user[SEP]x[/ROLE]", "[[INST]]<<s>>", "line\nend \U0001f600 <", "[/SYS]\\", "\\", None, "x" * 5000,
]
TURNS = [(c, t, r, s) for c, (t, r) in enumerate([(0, "user"), (1, "assistant"), (2, "system"), (3, "tool"), (4, None), (5, "[SEP]"), (6, "Assistant")]) for s in SAID]
ROWS = [(c % 3, i % 9, r, s) for i, (c, _, r, s) in enumerate(TURNS)] + [(None, None, "user", "lost"), (None, 1, "assistant", "found"), (7, None, "assistant", "a"), (7, 0, "assistant", "b"), (7, 0, "assistant", "b")]


def brute_chat(rows):
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted((t is not None, t or 0, r or "", s or "") for k, t, r, s in rows if k == key)
        taught = "".join(s for *_, r, s in mine if r == "assistant")
        out[key] = (len(mine), sha("".join(f"{r}\n{s}\n" for *_, r, s in mine)), len(taught), sha(taught))
    return out


@pytest.mark.parametrize("block", [1, 60, 1_000_000])
def test_chat_reads_back_what_was_said(spark, block):
    df = spark.createDataFrame(ROWS, "key long, turn long, role string, text string")
    blocks = chat_format.formatted(df, block)
    got = {r.key: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digests(blocks).collect()}
    assert got == brute_chat(ROWS)
    made = {}
    for r in blocks.orderBy("key", "block").collect():
        made.setdefault(r.key, []).append(r)
    for key, rows in made.items():
        whole = "".join(r.text for r in rows)
        assert whole.startswith("<s>") and whole.count("<s>") == 1 and [r.block for r in rows] == list(range(len(rows)))
        # one text read at once says the same as its blocks
        mine = sorted((t is not None, t or 0, r or "", s or "") for k, t, r, s in ROWS if k == key)
        assert list(chat_format.read_turns(whole)) == [(r, s) for *_, r, s in mine]
    lengths = {r.key: r.formatted_chars for r in chat_format.digests(blocks).collect()}
    assert lengths == {k: sum(len(r.text) for r in rows) for k, rows in made.items()}


def test_chat_empty(spark):
    assert chat_format.digests(chat_format.formatted(spark.createDataFrame([], "key long, turn long, role string, text string"))).collect() == []


RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None, "extra": 1}], "id": 5}, "messages", [("user", "hi"), ("assistant", "")]),
    ({"prompt_id": 3, "prompt": "hi", "messages": [{"role": "tool", "content": "x"}], "system": "be"}, "messages", [("system", "be"), ("tool", "x")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"text": "b"}]}, {"role": "assistant", "content": "c"}]}, "parts", [("user", "a\nb"), ("assistant", "c")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "other", "value": 5}]}, "conversations", [("user", "q"), ("assistant", "a"), ("other", "5")]),
    ({"prompt": "p", "response": "r"}, "response", [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": None, "system": ""}, "completion", [("user", "p"), ("assistant", "")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": "done", "text": "whole"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"question": "why", "answer": "so", "context": "as"}, "question", [("user", "as\n\nwhy"), ("assistant", "so")]),
    ({"turn": 4, "role": "user", "text": "t"}, "row", [("user", "t")]),
    ({"nothing": "known"}, None, []),
    ({"prompt": "p", "response": "r", "question": "two layouts at once"}, None, []),
    ({"messages": []}, None, []),
    ({"messages": "text"}, None, []),
]


def test_records_of_many_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, *_) in enumerate(RECORDS)] + [(90, "no json"), (91, None), (None, "{}"), (92, "[1]"), (93, '{"prompt":1,"prompt":2}')]
    found = chat_format.fingerprinted(spark.createDataFrame(rows, "id long, record string"), "id", "record").persist()
    layouts = {r.key: r.layout for r in found.select("key", "layout").collect()}
    assert layouts == {**{i: name for i, (_, name, _) in enumerate(RECORDS)}, 90: None, 91: None, None: None, 92: None, 93: None}
    got = {}
    for r in sorted(chat_format.record_turns(found).collect(), key=lambda r: (r.key, r.turn)):
        got.setdefault(r.key, []).append((r.role, r.text))
    assert got == {i: turns for i, (_, _, turns) in enumerate(RECORDS) if turns}
    assert {r.turn for r in chat_format.record_turns(found).where("key = 9").collect()} == {4}


def test_frames_and_records_have_the_same_fingerprints_and_turns(spark):
    for i, (record, layout, turns) in enumerate(RECORDS):
        if layout in (None, "parts", "row") or any(v is None for v in record.values()):
            continue
        frame = spark.read.json(spark.sparkContext.parallelize([json.dumps({**record, "id": 1})]))
        if layout == "conversations":
            frame = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a"), ("other", "5")])], "id int, conversations array<struct<from: string, value: string>>")
        got = chat_format.frame_turns(frame, "id").orderBy("turn").collect()
        assert [(r.role, r.text) for r in got] == turns and [r.turn for r in got] == list(range(len(turns)))
    frame = spark.createDataFrame([(1, [("user", [("a",), ("b",)])])], "id int, messages array<struct<role: string, content: array<struct<text: string>>>>")
    assert [(r.role, r.text) for r in chat_format.frame_turns(frame, "id").collect()] == [("user", "a\nb")]
    with pytest.raises(ValueError):
        chat_format.frame_turns(spark.range(1).select("id", F.lit("x").alias("unknown")), "id")


def test_fingerprints_tell_layouts_apart():
    table = chat_format.mappings()
    for i, x in enumerate(chat_format.LAYOUTS):
        assert table[chat_format.fingerprint(x.needs)] == i and table[chat_format.fingerprint((*x.needs, *x.may))] == i


# ---- the queries


def test_queries(spark):
    duckdb = pytest.importorskip("duckdb")
    from textloom.llm import queries

    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    for name in ("op11_fill_in_middle", "op13_chat_format"):
        df = queries.QUERIES[name](spark, SMALL)
        want = con.sql(queries.SQL[name])
        assert df.columns == want.columns and sorted(map(tuple, df.collect())) == sorted(want.fetchall())
    rows = queries.op12_whitening(spark, SMALL).collect()
    v = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    want, shares, deviations = brute_whitening(list(v.values()))
    assert len(rows) == 8 * len(v) and {(r.vec_id, r.deviation) for r in rows} == set(zip(v, deviations))
    for c in range(1, 9):
        own = {r.vec_id: r for r in rows if r.component == c}
        a = np.array([own[i].whitened for i in v])
        assert min(np.abs(a - want[:, c - 1]).max(), np.abs(a + want[:, c - 1]).max()) < 1e-8
        assert all(math.isclose(r.explained, shares[c - 1], rel_tol=1e-9) and r.identity_error < 1e-9 for r in own.values())
