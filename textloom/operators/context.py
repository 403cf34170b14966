"""Answer assembly: context, prompt, post-processing and confidence. The language model is injected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

#: The prompt's texts.
SYSTEM_PROMPT = (
    "You are a concise retrieval-augmented AI assistant. Your task is to synthesize information from the retrieved context and answer the user's question. "
    "Rules: 1. Use ONLY information present in the provided context. 2. Synthesize across chunks — merge relevant facts, remove duplication. "
    "3. Answer directly. Do NOT open with 'Based on the context', 'According to the documents', or any similar preamble. "
    "4. Keep the answer short (2-4 sentences), factual, and information-dense. 5. Do NOT mention chunks, sources, or the retrieval process. "
    "6. Do NOT hallucinate or add external knowledge. 7. Always attempt to answer using whatever relevant information exists in the context, even if partial. "
    "Only respond \"I do not have enough reliable information to answer that.\" when the context contains ZERO relevant facts — not merely an imperfect or indirect answer."
)
ADDENDA = {
    "statement": " The question asks what someone SAID, STATED, or ANNOUNCED. Find direct quotes or stated positions in the context. If none exist, say so explicitly.",
    "biography": " The question asks about a PERSON. Report their role, title, position, or background as stated in the context.",
    "event": " The question asks about a SPECIFIC EVENT. Report what happened, who was involved, and the outcome.",
    "causal": " The question asks about CAUSES or REASONS. List only factors explicitly stated in the context.",
    "opinion": " The question asks about REACTIONS or OPINIONS. Report only documented positions described in the context.",
}
NO_ANSWER = "I do not have enough reliable information to answer that."
#: Answer patterns.
PREAMBLE = (
    r"(?i)^(?:based on (?:the )?(?:context|provided|above|documents?|passages?)[,:\s]*|according to (?:the )?(?:context|documents?|passages?|provided information)[,:\s]*|"
    r"(?:the )?(?:context|documents?|passages?) (?:states?|mentions?|indicates?|shows?|suggests?)[,:\s]*|from (?:the )?(?:context|provided (?:context|documents?))[,:\s]*|"
    r"as (?:mentioned|stated|noted|described) in (?:the )?(?:context|document)[,:\s]*|the provided (?:context|documents?) (?:states?|mentions?|indicates?)[,:\s]*)"
)
DONT_KNOW = r"(?i)(i don.t know|not present|cannot find|no information|not found in|do not have enough|insufficient information)"
ANSWER_STOPS = ("the", "a", "an", "is", "are", "was", "were", "in", "of", "to", "and", "or", "it", "its")
E_APPROX = 2.718  # a fixed value of the confidence formula, not e


def compress(docs: DataFrame, k: int = 5, max_words: int = 150) -> DataFrame:
    """The context of each qid: (qid, doc_id, chunk_id, chunk_text, ce_score, rank in) -> with pos.

    Empty texts go, each document keeps its best chunk (of ties the first), the k best are cut to max_words.
    """
    d = docs.where(F.trim(F.regexp_replace(T.text_or_empty(F.col("chunk_text")), r"\s+", " ")) != "").withColumn("ce_score", F.coalesce("ce_score", F.lit(0.0)))
    d = d.withColumn("_n", F.row_number().over(W.partitionBy("qid", "doc_id").orderBy(F.desc("ce_score"), "rank"))).where("_n = 1")
    d = d.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("ce_score"), "rank"))).where(F.col("pos") <= k)
    return d.withColumn("chunk_text", T.truncate_words(F.col("chunk_text"), max_words)).drop("_n")


def min_ce(context: DataFrame, threshold: float = -15.0) -> DataFrame:
    return context.where(F.coalesce("ce_score", F.lit(0.0)) >= threshold)


def prompts(queries: DataFrame, context: DataFrame) -> DataFrame:
    """(qid, messages array<struct<role, content>>) for (qid, query, intent)."""
    block = F.concat(F.lit("[Context "), F.col("pos").cast("string"), F.lit("]\n"), F.col("chunk_text"))
    c = context.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("t")))), lambda s: s["t"]), "\n\n").alias("_context"))
    q = queries.join(c, "qid")
    addenda = F.create_map(*[F.lit(x) for kv in ADDENDA.items() for x in kv])
    extra = F.try_element_at(addenda, F.col("intent"))
    system = F.concat(F.lit(SYSTEM_PROMPT), F.when(extra.isNotNull(), F.concat(F.lit(" IMPORTANT:"), extra)).otherwise(F.lit("")))
    user = F.concat(F.col("_context"), F.lit("\n\nUser Question:\n"), F.trim(F.col("query")))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return q.select("qid", F.array(message("system", system), message("user", user)).alias("messages"))


def post_process(answer: Column, max_sentences: int = 4) -> Column:
    """Without ``Answer:`` and preambles, first letter upper, the first sentences."""
    a = F.trim(F.regexp_replace(T.text_or_empty(answer), r"(?i)^Answer:\s*", ""))
    a = F.trim(F.regexp_replace(a, PREAMBLE, ""))
    a = T.sentence_case(a)
    return F.trim(T.first_sentences(a, max_sentences)) if max_sentences > 0 else F.trim(a)


def confidence(answer: Column, avg_ce: Column, context_words: Column) -> Column:
    """Half squashed mean score, half coverage of the answer's content words, less a penalty for not knowing."""
    content = F.array_except(T.word_set(answer), F.array(*[F.lit(w) for w in ANSWER_STOPS]))
    coverage = F.when(F.size(content) > 0, F.size(F.array_intersect(content, context_words)) / F.size(content)).otherwise(F.lit(0.0))
    squashed = 1.0 / (1.0 + F.pow(F.lit(E_APPROX), -avg_ce))
    penalty = F.when(answer.rlike(DONT_KNOW), F.lit(0.6)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * squashed + 0.5 * coverage - penalty))


def extract(text: Column, n: int = 2) -> Column:
    """The first sentences of the best context."""
    return F.trim(T.first_sentences(text, n))


def generate(queries: DataFrame, context: DataFrame, llm: Callable[[Column], Column] | None = None, max_sentences: int = 4, completed: DataFrame | None = None) -> DataFrame:
    """(qid, answer, confidence, context_count, used_docs, citations, fallback) for (qid, query, intent).

    ``llm`` maps a messages column to text, null on failure; ``completed`` holds such texts, as (qid, text),
    of what ``generation.complete`` made of the prompts. Without either or on failure the answer is extracted. A query without context gets a fixed sentence at confidence 0.
    """
    c = context.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("pos", "doc_id", "chunk_text", "ce_score"))).alias("_c"), F.avg("ce_score").alias("_ce"), F.count("*").alias("_n")
    )
    q = queries.select("qid", "query", "intent").join(c, "qid", "left")
    if completed is not None:
        q = q.join(completed.select("qid", F.col("text").alias("_raw")), "qid", "left")
    elif llm is not None:
        q = q.join(prompts(queries, context), "qid", "left").withColumn("_raw", F.when(F.col("messages").isNotNull(), llm(F.col("messages"))))
    else:
        q = q.withColumn("_raw", F.lit(None).cast("string"))
    own = F.when(F.trim(T.text_or_empty(F.col("_raw"))) != "", post_process(F.col("_raw"), max_sentences))
    answer = F.when(F.col("_n").isNull(), F.lit(NO_ANSWER)).otherwise(F.coalesce(own, extract(F.element_at("_c", 1)["chunk_text"])))
    words = F.array_distinct(F.flatten(F.transform("_c", lambda s: T.word_set(s["chunk_text"]))))
    q = q.withColumn("answer", answer).withColumn("_words", words)
    return q.select(
        "qid", "answer", F.round(F.when(F.col("_n").isNull(), F.lit(0.0)).otherwise(confidence(F.col("answer"), F.col("_ce"), F.col("_words"))), 6).alias("confidence"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("context_count"),
        F.coalesce(F.transform("_c", lambda s: s["doc_id"].cast("string")), F.expr("cast(array() as array<string>)")).alias("used_docs"),
        F.expr("cast(array() as array<string>)").alias("citations"), own.isNull().alias("fallback"),
    )


#: What an error's text says of its kind, in order.
ERROR_KINDS = (
    ("rate_limit", ("429", "rate limit", "rate_limit", "resource_exhausted")), ("auth", ("401", "403", "unauthorized", "invalid api key", "api_key")),
    ("quota", ("402", "quota", "insufficient_quota")), ("timeout", ("timeout", "timed out", "deadline")),
)


#: What an HTTP status says of an error's kind.
STATUS_KINDS = {429: "rate_limit", 401: "auth", 403: "auth", 402: "quota"}


def error_kind(message: Column, status: Column | None = None, exception: Column | None = None) -> Column:
    """rate_limit, auth, quota, timeout, connection or other: by the HTTP status, else the exception's name, else the text."""
    text = F.lower(T.text_or_empty(message))
    kinds = [] if status is None else [F.when(status == code, kind) for code, kind in STATUS_KINDS.items()]
    if exception is not None:
        name = F.lower(T.text_or_empty(exception))
        kinds += [F.when(F.contains(name, F.lit(kind)), kind) for kind in ("timeout", "connection")]
    for kind, words in ERROR_KINDS:
        kinds.append(F.when(F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(True)) for w in words], F.lit(False)), F.lit(kind)))
    return F.coalesce(*kinds, F.lit("other"))


def is_final(kind: Column) -> Column:
    """Whether neither a retry nor another model helps."""
    return kind.isin("auth", "quota")


def retry_wait(attempt: Column, message: Column, jitter: Column | None = None, kind: Column | None = None) -> Column:
    """Seconds before a retry: 2 * 2^attempt within 20 % of jitter (-1 to 1); of a rate limit at least what its text asks for and one more."""
    asked = F.regexp_extract(F.lower(T.text_or_empty(message)), r"(?:try again in|retry after)\s*([0-9]+\.?[0-9]*)\s*s", 1).try_cast("double") + 1.0
    own = 2.0 * F.pow(F.lit(2.0), attempt) * (1.0 + 0.2 * (jitter if jitter is not None else F.lit(0.0)))
    return F.greatest(own, F.when((kind if kind is not None else error_kind(message)) == "rate_limit", asked))


def next_model(models: Column, failed: Column, kind: Column) -> Column:
    """The model to try after ``failed`` ones of a queue; null where the kind is final or none is left."""
    return F.when(~is_final(kind), F.try_element_at(models, (failed + 1).cast("int")))
