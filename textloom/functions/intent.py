"""Query understanding: intent, subject and topic, and expansion into variants. Columns only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_space

W = r"[\p{L}\p{N}_]"
#: The intent patterns, in order of priority.
INTENTS = (
    ("statement", r"(?i)\b(said|say|says|stated|announced|claimed|argued|declared|testified|commented on|spoke about|stance on|position on|views? on|opinion on|response to|reaction to|according to|quoted|statement (?:about|on|regarding)|remarks? (?:about|on|regarding))\b"),
    ("biography", rf"(?i)^(who (?:is|was|are|were)\b|tell me about\b|what is {W}[\p{{L}}\p{{N}}_\s]{{1,30}} known for|describe \b|background of\b|biography of\b|profile of\b)"),
    ("event", r"(?i)^(what happened\b|when did\b|where did\b|what was the (?:outcome|result|aftermath|consequence)\b|how did .{2,40}(?:happen|end|unfold)\b|what occurred\b|what took place\b|what (?:is|are|was|were) the (?:details|facts) of\b)"),
    ("causal", r"(?i)^(why\b|what caused\b|what led to\b|what resulted in\b|reasons? for\b|factors? behind\b|what (?:are|were) the (?:reasons|causes|factors)\b|how did .{2,40}(?:cause|lead to|result in)\b)"),
    ("opinion", r"(?i)\b(controversy|controversial|debate|critics?\b|criticized|opposed\b|supporters?\b|backlash|condemned|praised|disputed|public reaction|opinion poll|survey says)\b"),
)
#: Subject and topic patterns.
STATEMENT_PARTS = (
    r"(?i)(?:what did|did)\s+(.+?)\s+(?:say|state|announce|claim|argue|declare|comment|testify|respond)\s*(?:about|on|regarding|to)?\s*(.+?)(?:\?|$)",
    r"(?i)^(.+?)(?:'s)?\s+(?:stance|position|view|opinion|response|reaction|statement|remarks?)\s+(?:on|to|about|regarding)\s+(.+?)(?:\?|$)",
)
BIOGRAPHY_PART = r"(?i)(?:who (?:is|was|are|were)|tell me about|describe|background of|biography of|profile of)\s+(.+?)(?:\?|$)"
#: Expansion templates.
DEFAULT_TEMPLATES = ("{query}", "{query} causes", "{query} impact", "{query} effects", "reasons for {query}")
INTENT_TEMPLATES = {
    "statement": ("{query}", "{subject} said stated announced {topic}", "{subject} statement remarks on {topic}", "{subject} comments position on {topic}"),
    "biography": ("{query}", "{subject} background career history", "{subject} role position"),
    "event": ("{query}", "{query} outcome result", "{query} what happened timeline"),
    "causal": ("{query}", "{query} causes reasons why", "{query} factors led to resulted"),
    "opinion": ("{query}", "{query} reaction response critics", "{query} debate controversy"),
    "general": ("{query}", "{query} news details", "{query} recent developments"),
}


def intent(query: Column) -> Column:
    """The first intent whose pattern is found, else general."""
    return F.coalesce(*[F.when(query.rlike(p), F.lit(name)) for name, p in INTENTS], F.lit("general"))


def subject_topic(query: Column, kind: Column) -> Column:
    """struct(subject, topic); null where the intent has none or no pattern fits."""
    some = lambda p, i: F.nullif(F.trim(F.regexp_extract(query, p, i)), F.lit(""))
    first, second = STATEMENT_PARTS
    said = query.rlike(first)
    part = lambda i: F.when(said, some(first, i)).otherwise(some(second, i))
    subject = F.when(kind == "statement", part(1)).when(kind == "biography", some(BIOGRAPHY_PART, 1))
    return F.struct(subject.alias("subject"), F.when(kind == "statement", part(2)).alias("topic"))


def _filled(template: str, parts: dict[str, Column]) -> Column:
    """The template as a column; null if a part that it names is null."""
    pieces, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        pieces += [F.lit(before), parts[name]] if before else [parts[name]]
    return F.trim(F.concat(*pieces, *([F.lit(rest)] if rest else [])))


def _first_distinct(variants: Column, n: int) -> Column:
    return F.slice(F.array_distinct(F.filter(variants, lambda v: v.isNotNull() & (v != ""))), 1, n)


def expand(query: Column, n: int = 3, templates=DEFAULT_TEMPLATES) -> Column:
    """Variants from fixed templates; the query alone for n up to 1."""
    base = normalize_space(query)
    if n <= 1:
        return F.array(base)
    got = _first_distinct(F.array(*[_filled(t, {"query": base}) for t in templates]), n)
    return F.when(F.array_contains(got, base), got).otherwise(F.slice(F.concat(F.array(base), got), 1, n))


def expand_with_intent(query: Column, kind: Column, n: int = 3) -> Column:
    """The query, then its intent's templates that can be filled, then the default templates, n in all."""
    base, found = normalize_space(query), subject_topic(query, kind)
    parts = {"query": base, "subject": found["subject"], "topic": found["topic"]}
    own = {k: F.array(*[_filled(t, parts) for t in ts]) for k, ts in INTENT_TEMPLATES.items()}
    chosen = reduce(lambda c, k: c.when(kind == k, own[k]), list(own)[1:], F.when(kind == list(own)[0], own[list(own)[0]])).otherwise(own["general"])
    default = F.array(*[_filled(t, {"query": base}) for t in DEFAULT_TEMPLATES[1:]])
    return _first_distinct(F.concat(F.array(base), chosen, default), n)
