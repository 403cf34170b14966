"""Chat formatting: records of many layouts become turns, turns become marked text with a loss mask.

The nested field paths of a schema, or of a single record, are hashed; the hash selects a declarative
mapping from layout to turns. Field paths that no layout knows take no part in the hash, so that a
source's own columns don't hide its layout. Texts of a conversation are written with control strings
around each turn; what looks like one inside a text is escaped, and reading back undoes it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- layouts and their fingerprints ---------------------------------------------------------------------


@dataclass(frozen=True)
class One:
    """A turn of a fixed role: the texts at ``paths`` that are there and not empty, a blank line between them. ``must``: a turn even without text."""

    role: str
    paths: tuple[str, ...]
    must: bool = True


@dataclass(frozen=True)
class Each:
    """A turn for each element of an array; ``role`` and ``text`` are fields of it. Texts of a list of parts are joined by line ends."""

    path: str
    role: str
    text: str
    part: str | None = None


@dataclass(frozen=True)
class Row:
    """The record is itself one turn of its conversation."""

    turn: str
    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    """Field paths that a layout needs, those that it may have besides, its turns, and other names of roles."""

    name: str
    needs: tuple[str, ...]
    turns: tuple[One | Each | Row, ...]
    may: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


SHORT_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
SYSTEM = One("system", ("system",), must=False)
LAYOUTS = (
    Layout("row", ("turn", "role", "text"), (Row("turn", "role", "text"),)),
    Layout("messages", ("messages[].role", "messages[].content"), (SYSTEM, Each("messages", "role", "content")), ("system", "prompt")),
    Layout("parts", ("messages[].role", "messages[].content", "messages[].content[].text"), (SYSTEM, Each("messages", "role", "content", "text")), ("system", "prompt")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), (SYSTEM, Each("conversations", "from", "value")), ("system",), SHORT_NAMES),
    Layout("response", ("prompt", "response"), (SYSTEM, One("user", ("prompt",)), One("assistant", ("response",))), ("system",)),
    Layout("completion", ("prompt", "completion"), (SYSTEM, One("user", ("prompt",)), One("assistant", ("completion",))), ("system",)),
    Layout("instruction", ("instruction", "output"), (SYSTEM, One("user", ("instruction", "input")), One("assistant", ("output",))), ("system", "input", "text")),
    Layout("question", ("question", "answer"), (SYSTEM, One("user", ("context", "question")), One("assistant", ("answer",))), ("system", "context")),
)


def known_paths(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for x in layouts for p in (*x.needs, *x.may)})


def fingerprint(paths) -> str:
    """The hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def mappings(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, int]:
    """Fingerprint -> place of the layout: each layout with any of the paths that it may have. A set of paths that two layouts claim is the first one's."""
    out: dict[str, int] = {}
    for i, x in enumerate(layouts):
        for k in range(len(x.may) + 1):
            for some in combinations(x.may, k):
                out.setdefault(fingerprint((*x.needs, *some)), i)
    return out


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Nested field paths of a schema; an array's elements are ``path[]``."""
    if isinstance(kind, T.StructType):
        named = [(f"{at}.{f.name}".lstrip("."), f.dataType) for f in kind.fields]
        return {p for name, own in named for p in (name, *schema_paths(own, name))}
    return schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else set()


def _present(v: Column, path: str) -> Column:
    """Whether a VARIANT has a field path; of arrays, whether any element has it."""
    head, array, rest = path.partition("[]")
    if not array:
        return F.try_variant_get(v, f"$.{head}", "variant").isNotNull()
    return F.coalesce(F.exists(F.try_variant_get(v, f"$.{head}", "array<variant>"), lambda m: _present(m, rest.lstrip("."))), F.lit(False))


def fingerprinted(df: DataFrame, key: str, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, record VARIANT, fingerprint, layout) of JSON texts or VARIANTs; layout is null where no mapping fits or the text is no JSON."""
    v = F.try_parse_json(F.col(record)) if isinstance(df.schema[record].dataType, T.StringType) else F.col(record)
    d = df.select(F.col(key).alias("key"), v.alias("record"))
    found = F.array_compact(F.array(*[F.when(_present(F.col("record"), p), F.lit(p)) for p in known_paths(layouts)]))
    d = d.withColumn("fingerprint", F.when(F.col("record").isNotNull(), F.sha2(F.array_join(found, "\n").cast("binary"), 256)))
    table = F.create_map(*[F.lit(x) for h, i in mappings(layouts).items() for x in (h, layouts[i].name)])
    return d.withColumn("layout", F.try_element_at(table, F.coalesce("fingerprint", F.lit(""))))


TURN = "array<struct<turn: bigint, role: string, text: string>>"


def _turns(layout: Layout, text, elements, number) -> Column:
    """The turns of a layout as an array; text(path), elements(rule) and number(path) read a record's fields."""
    named = lambda r: F.coalesce(*[F.when(r == a, F.lit(b)) for a, b in layout.roles], r, F.lit(""))
    lists = []
    for rule in layout.turns:
        if isinstance(rule, Row):
            return F.array(F.struct(number(rule.turn).alias("turn"), named(text(rule.role)).alias("role"), F.coalesce(text(rule.text), F.lit("")).alias("text"))).cast(TURN)
        if isinstance(rule, Each):
            lists.append(F.transform(elements(rule), lambda m: F.struct(named(m["role"]).alias("role"), F.coalesce(m["text"], F.lit("")).alias("text"))))
        elif paths := [p for p in rule.paths if text(p) is not None]:
            joined = F.array_join(F.filter(F.array(*map(text, paths)), lambda x: F.coalesce(x != "", F.lit(False))), "\n\n")
            turn = F.array(F.struct(F.lit(rule.role).alias("role"), joined.alias("text")))
            lists.append(turn if rule.must else F.when(joined != "", turn))
    none = F.expr("cast(array() as array<struct<role: string, text: string>>)")
    every = F.concat(*[F.coalesce(x.cast("array<struct<role: string, text: string>>"), none) for x in lists])
    return F.transform(every, lambda t, i: F.struct(i.cast("long").alias("turn"), t["role"].alias("role"), t["text"].alias("text"))).cast(TURN)


def record_turns(found: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, turn, role, text) of what ``fingerprinted`` returns. Records without a layout have no turns; they stay to be seen there."""
    v = F.col("record")
    text = lambda p: F.try_variant_get(v, f"$.{p}", "string")

    def elements(rule: Each) -> Column:
        inner = lambda m, p: F.try_variant_get(m, f"$.{p}", "string")

        def content(m):
            whole = inner(m, rule.text)
            if not rule.part:
                return whole
            parts = F.transform(F.try_variant_get(m, f"$.{rule.text}", "array<variant>"), lambda x: inner(x, rule.part))
            return F.coalesce(F.array_join(parts, "\n"), whole)

        return F.transform(F.try_variant_get(v, f"$.{rule.path}", "array<variant>"), lambda m: F.struct(inner(m, rule.role).alias("role"), content(m).alias("text")))

    number = lambda p: F.try_variant_get(v, f"$.{p}", "bigint")
    cases = [F.when(F.col("layout") == x.name, _turns(x, text, elements, number)) for x in layouts]
    return found.select("key", F.inline(F.coalesce(*cases)))


def frame_turns(df: DataFrame, key: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, turn, role, text) of a frame whose own schema says its layout; the fingerprint is taken once, when the plan is made.

    Null texts and roles are empty. A schema that no mapping fits is refused.
    """
    paths = schema_paths(df.select(*[c for c in df.columns if c != key]).schema) & set(known_paths(layouts))
    at = mappings(layouts).get(fingerprint(paths))
    if at is None:
        raise ValueError(f"no layout has the fields {sorted(paths)}")
    names = set(df.columns)
    text = lambda p: F.col(p).cast("string") if p in names else None

    def elements(rule: Each) -> Column:
        def content(m):
            return F.array_join(F.transform(m[rule.text], lambda x: x[rule.part].cast("string")), "\n") if rule.part else m[rule.text].cast("string")

        return F.transform(rule.path, lambda m: F.struct(m[rule.role].cast("string").alias("role"), content(m).alias("text")))

    return df.select(F.col(key).alias("key"), F.inline(_turns(layouts[at], text, elements, lambda p: F.col(p).cast("long"))))


# ---- template -------------------------------------------------------------------------------------------

#: Control strings. Each opens with < or [, holds no other such sign, and none begins another.
START, END = "<s>", "</s>"
USER, SYSTEM_MARKS, OTHER = ("[INST]", "[/INST]"), ("[SYS]", "[/SYS]"), ("[ROLE]", "[SEP]", "[/ROLE]")
BODIES = r"/?s>|/?INST\]|/?SYS\]|/?ROLE\]|SEP\]"
CONTROL = r"</?s>|\[/?INST\]|\[/?SYS\]|\[/?ROLE\]|\[SEP\]"
#: Characters of a block of formatted text, unless one turn alone has more.
BLOCK = 1_000_000


def escaped(text: Column) -> Column:
    r"""A backslash more within everything that is a control string but for backslashes after its first sign: <s> is <\s>, <\s> is <\\s>."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({BODIES})", r"$1\\$2$3")


def unescape(text: str) -> str:
    import re

    return re.sub(rf"([<\[])\\(\\*)({BODIES})", r"\1\2\3", text)


def formatted(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, block, text, loss array of (from, to)) of (key, turn, role, text): conversations as marked text.

    Turns follow each other by turn (nulls first), role and text; repeated rows stay. A conversation
    begins with ``<s>``. Turns: ``[INST]text[/INST]`` of user, ``text</s>`` of assistant, ``[SYS]text[/SYS]``
    of system, ``[ROLE]role[SEP]text[/ROLE]`` of any other role. loss: where assistant texts stand, in code
    points of the block. A conversation is one block, or several, cut between turns, where it has more than
    ``block`` characters, so that no row grows with it: its blocks, in order, are its text.

    Null texts and roles are empty; rows without a key make one conversation. A conversation's rows meet in
    one task, sorted and streamed, never held together. Blocks lie in order, a conversation's in one partition.
    """
    role, e = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    d = turns.select("key", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text")
    around = lambda a, b: F.concat(F.lit(a), e, F.lit(b))
    piece = F.when(role == "user", around(*USER)).when(role == "assistant", F.concat(e, F.lit(END))).when(role == "system", around(*SYSTEM_MARKS))
    d = d.select("key", (role == "assistant").alias("taught"), piece.otherwise(F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]), e, F.lit(OTHER[2]))).alias("piece"))
    kind = turns.schema["key"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        at, number, pieces, chars, loss, rows, held = None, 0, [], 0, [], [], 0

        def out(b_type) -> pa.RecordBatch:
            nonlocal rows, held
            columns = list(zip(*rows))
            rows, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(columns[0], b_type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], spans)], ["key", "block", "text", "loss"])

        b_type = None
        for b in batches:
            b_type = b.schema.field(0).type
            for key, taught, piece in zip(*(c.to_pylist() for c in b.columns)):
                if pieces and (key != at or chars + len(piece) > block):
                    rows.append((at, number, "".join(pieces), loss))
                    held, number = held + chars, number + 1
                    pieces, chars, loss = [], 0, []
                    if held > block:
                        yield out(b_type)
                if at != key or not number and not pieces:
                    at, number, pieces, chars, loss = key, 0, [START], len(START), []
                if taught:
                    loss.append({"from": chars, "to": chars + len(piece) - len(END)})
                pieces.append(piece)
                chars += len(piece)
        if pieces:
            rows.append((at, number, "".join(pieces), loss))
        if rows:
            yield out(b_type)

    return d.mapInArrow(write, f"key {kind}, block int, text string, loss array<struct<from: int, to: int>>")


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a block's text."""
    import re

    role, at = "", 0
    ends = {END: "assistant", USER[1]: "user", SYSTEM_MARKS[1]: "system"}
    for mark in re.finditer(CONTROL, text):
        part, at, name = text[at : mark.start()], mark.end(), mark[0]
        if name == OTHER[1]:
            role = unescape(part)
        elif name == OTHER[2]:
            yield role, unescape(part)
        elif name in ends:
            yield ends[name], unescape(part)


def digests(blocks: DataFrame) -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from blocks that lie as ``formatted`` returns them.

    turns_sha256: of role, line end, text, line end of each turn; loss_sha256: of all that the loss mask
    covers, unescaped. Digests go on from block to block; a task holds one batch of blocks.
    """
    kind = blocks.schema["key"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        open_row, b_type = None, None
        for b in batches:
            b_type, rows = b.schema.field(0).type, []
            for key, number, text, loss in zip(*(c.to_pylist() for c in b.columns)):
                if not number:
                    if open_row:
                        rows.append(open_row)
                    open_row = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, turn in read_turns(text):
                    open_row[1] += 1
                    open_row[2].update(f"{role}\n{turn}\n".encode())
                for span in loss:
                    taught = unescape(text[span["from"] : span["to"]])
                    open_row[3] += len(taught)
                    open_row[4].update(taught.encode())
                open_row[5] += len(text)
            if rows:
                yield done(rows, b_type, kinds, names)
        if open_row:
            yield done([open_row], b_type, kinds, names)

    def done(rows, b_type, kinds, names) -> pa.RecordBatch:
        columns = list(zip(*[[x.hexdigest() if hasattr(x, "hexdigest") else x for x in r] for r in rows]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [b_type, *kinds])], names)

    return blocks.select("key", "block", "text", "loss").mapInArrow(read, f"key {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: DuckDB SQL for the rows of ``op13_chat_format``.
CHAT_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '</s>[INST] ok [/INST]' FROM (SELECT unnest([0, 1]) AS i)),
e AS (SELECT *, length(regexp_replace(t, '([<\[])(\\*)({BODIES})', '\1\\\2\3', 'g')) AS n, length(regexp_replace(r, '([<\[])(\\*)({BODIES})', '\1\\\2\3', 'g')) AS m FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n + CASE r WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 WHEN 'system' THEN 11 ELSE m + 18 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
