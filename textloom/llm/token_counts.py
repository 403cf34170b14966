"""Exact token counts of whole texts by a map-side two-tier lookup.

Tier one is a compact table (pre-token -> number of tokens) of the corpus's frequent pre-tokens,
broadcast to the workers. Tier two encodes what misses it with the tokenizer itself and keeps the
answer in the worker's cache. No pre-token is ever shuffled: the frequent ones come from summaries of a
bounded sample, one row a partition, and the texts are read by Python once.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of the tokenizer file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of these characters alone are normalised alike by the library and here: composed already,
#: one-to-one lower case, undisputed white space. Any other text goes through the library whole.
PLAIN = r"[\t\n\r\x20-\x7e\xa1-įı-ſ]*"


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker."""
    return sys.modules.setdefault("_textloom_worker", type(sys)("_textloom_worker")).__dict__.setdefault(name, {})


def _tokenizer(path: str):
    """The tokenizer, loaded once a worker, and the splitter of plain texts; None if the file isn't of the kind above."""
    got = worker_cache("tokenizers")
    if path not in got:
        import json
        import re
        import unicodedata

        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        spec = json.loads(t.to_str())
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
        fits = (first.get("pattern") or {}).get("Regex") == PATTERN and kinds == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>"
        special = [a["content"] for a in spec["added_tokens"]]
        # over plain texts, explicit classes say the same as the file's Unicode classes and match faster
        plain = [c for c in map(chr, range(0x30, 0x180)) if re.fullmatch(PLAIN, c)]
        of = lambda kind: "".join(c for c in plain if unicodedata.category(c)[0] == kind)
        split = re.compile(PATTERN.replace(r"\p{L}", of("L")).replace(r"\p{N}", of("N"))).findall
        got[path] = t, split if fits else None, re.compile(PLAIN).fullmatch, special
    return got[path]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte value: printable Latin-1 for itself, the others from U+0100 on in turn."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Lengths(dict):
    """Tier two: pre-token -> number of tokens; a miss is encoded and kept, within ``bound`` entries."""

    def __init__(self, table: dict, tokenizer, bound: int):
        super().__init__(table)
        self.table, self.encode, self.bound, self.letters = table, tokenizer.model.tokenize, bound, dict(enumerate(_byte_letters()))

    def __missing__(self, token: str) -> int:
        n = len(self.encode(token if token.isascii() else token.encode().decode("latin-1").translate(self.letters)))
        if len(self) >= self.bound:
            self.clear()
            self.update(self.table)
        self[token] = n
        return n


def frequent_pretokens(df: DataFrame, path: str, size: int = 50_000, sample: int = 20_000, summary: int = 5_000, parts: int = 256) -> dict[str, int]:
    """The ``size`` most frequent pre-tokens (ties by code point) of a sample of the texts, with their token counts.

    About ``sample`` texts, by a hash of the text, are counted where they are; the ``summary`` most
    frequent of each partition, of at most ``parts`` partitions, reach the driver. The sample decides
    about speed alone: counts of tokens are exact whatever the table holds.
    """

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        _, split, plain, special = _tokenizer(path)
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist() if split else ():
                if text and plain(text) and not any(s in text for s in special):
                    seen.update(split(text.lower()))
                    if len(seen) > 40 * summary:
                        seen = Counter(dict(seen.most_common(20 * summary)))
        if seen:
            top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:summary]
            yield pa.RecordBatch.from_arrays([pa.array([[k for k, _ in top]]), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["tokens", "n"])

    every = max(1, df.count() // sample)
    some = df.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text")
    rows = some.mapInArrow(summaries, "tokens array<string>, n array<long>").orderBy(F.xxhash64("tokens", "n")).limit(parts).collect()
    total: dict[str, int] = {}
    for r in rows:
        for t, n in zip(r.tokens, r.n):
            total[t] = total.get(t, 0) + n
    tokens = sorted(total, key=lambda t: (-total[t], t))[:size]
    encode = _tokenizer(path)[0].encode_batch(tokens, add_special_tokens=False) if tokens else []
    return {t: len(e.ids) for t, e in zip(tokens, encode)}


def token_counts(df: DataFrame, tokenizer_path: str, limit: int = 2048, table_size: int = 50_000, cache_bound: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of (doc_id, text).

    Token counts are those of the tokenizers library, without begin, end or added special tokens;
    special strings within a text are treated as the library does by default. ``table_size`` bounds
    the broadcast table, ``cache_bound`` the entries of a worker's cache.

    Null text counts as empty (0 bytes, 0 tokens). Null and repeated doc_ids keep their rows. Empty
    input: no rows. Columns besides doc_id and text are ignored.
    """
    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = df.sparkSession.sparkContext.broadcast(frequent_pretokens(docs, tokenizer_path, table_size))
    key = (tokenizer_path, cache_bound, uuid.uuid4().hex)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, split, plain, special = _tokenizer(tokenizer_path)
        caches = worker_cache("lengths")
        if key not in caches:
            caches.clear()  # one table at a time
            caches[key] = Lengths(table.value, tokenizer, cache_bound)
        get = caches[key].__getitem__
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                if split and plain(text) and not any(s in text for s in special):
                    out.append(sum(map(get, split(text.lower()))))
                else:
                    out.append(len(tokenizer.encode(text, add_special_tokens=False).ids))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = df.schema["doc_id"].dataType.simpleString()
    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return docs.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
