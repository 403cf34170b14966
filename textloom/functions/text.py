"""Text columns: cleaning, tokens, sentences. All are built-in expressions inside code generation.

A word character is a letter or number of any script or an underscore; the classes are spelled out
because Java's \\w knows ASCII alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NON_WORD = r"[^\p{L}\p{N}_\s]"
WORD_RUN = r"([\p{L}\p{N}_]+)"
SENTENCE_END = r"(?<=[.!?])\s+"

#: The English stop-word list, as of its 179-word edition.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself "
    "she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll "
    "these those am is are was were be been being have has had having do does did doing a an the and but if or because as "
    "until while of at by for with about against between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y "
    "ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn "
    "mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " "))


def clean_text(c: Column) -> Column:
    """Lower case, punctuation to blanks, blanks collapsed and trimmed; null to empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(c)), NON_WORD, " "), r"\s+", " "))


def tokens(c: Column) -> Column:
    """The words of the cleaned text; an empty array for none."""
    return F.filter(F.split(clean_text(c), " "), lambda t: t != "")


def content_tokens(c: Column, stop_words=STOP_WORDS) -> Column:
    """``tokens`` without stop words; order and duplicates stay."""
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(tokens(c), lambda t: ~F.array_contains(stops, t))


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def with_title(title: Column, text: Column) -> Column:
    """``title. text``, or the text alone without a title."""
    title = text_or_empty(title)
    return F.when(title != "", F.concat(title, F.lit(". "), text_or_empty(text))).otherwise(text_or_empty(text))


def titled_lines(title: Column, text: Column) -> Column:
    """Title and text on lines of their own, trimmed."""
    title, text = F.trim(text_or_empty(title)), text_or_empty(text)
    return F.trim(F.when(title != "", F.concat(title, F.lit("\n"), text)).otherwise(text))


def content_hash(c: Column) -> Column:
    return F.md5(clean_text(c))


def query_id(c: Column) -> Column:
    """A stable id from the query's text."""
    return F.concat(F.lit("q_"), F.md5(text_or_empty(c)))


def is_positive(c: Column) -> Column:
    """Whether a relevance value of any type is a number above zero."""
    return F.coalesce(c.cast("string").try_cast("double") > 0, F.lit(False))


def word_set(c: Column) -> Column:
    """The distinct word runs of the lower-cased text, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(WORD_RUN), F.lit(1)))


def sentences(c: Column) -> Column:
    return F.split(text_or_empty(c), SENTENCE_END)


def first_sentences(c: Column, n: int) -> Column:
    return F.array_join(F.slice(sentences(c), 1, n), " ")


def sentence_case(c: Column) -> Column:
    """The first character upper-cased, the rest untouched."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def truncate_words(c: Column, n: int, mark: str = " …") -> Column:
    """The first ``n`` words, single-spaced, with a mark if any are cut."""
    words = F.filter(F.split(F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " ")), " "), lambda w: w != "")
    return F.concat(F.array_join(F.slice(words, 1, n), " "), F.when(F.size(words) > n, F.lit(mark)).otherwise(F.lit("")))


def query_problem(c: Column, most: int = 1000) -> Column:
    """Why a query is refused: empty (nothing but white space) or too_long (over ``most`` characters); else null."""
    bare = F.regexp_replace(text_or_empty(c), r"^\s+|\s+$", "")
    return F.when(bare == "", "empty").when(F.length(bare) > most, "too_long")
