"""Readers of corpora, queries, judgments and caches. All scans take a schema; none infers one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_flattened(columns: list[str] = (), *names: str) -> bool:
    """Whether one row carries document and query: by a query column, or by ``generated-queries`` in a name."""
    return "query" in columns or any("generated-queries" in n for n in names)


def first_field(df: DataFrame, *names: str) -> Column:
    """The first non-null of the columns that exist, as text; null if none exists."""
    return F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names if n in df.columns], F.lit(None).cast("string"))


def corpus(df: DataFrame) -> DataFrame:
    """(doc_id, title, text) of raw rows; rows without an id drop out, null texts are empty."""
    got = df.select(first_field(df, "_id", "id", "doc_id").alias("doc_id"), F.coalesce(first_field(df, "title"), F.lit("")).alias("title"), F.coalesce(first_field(df, "text"), F.lit("")).alias("text"))
    return got.where(F.coalesce("doc_id", F.lit("")) != "")


def queries(df: DataFrame) -> DataFrame:
    got = df.select(first_field(df, "_id", "id", "qid", "item_id").alias("qid"), F.coalesce(first_field(df, "text", "query"), F.lit("")).alias("query"))
    return got.where(F.coalesce("qid", F.lit("")) != "")


def qrels(df: DataFrame) -> DataFrame:
    """(qid, doc_id, rel int); a missing grade is 1; rows without ids drop out."""
    got = df.select(first_field(df, "query-id", "query_id", "qid").alias("qid"), first_field(df, "corpus-id", "doc_id").alias("doc_id"), F.coalesce(first_field(df, "score", "rel").try_cast("double").cast("int"), F.lit(1)).alias("rel"))
    return got.where((F.coalesce("qid", F.lit("")) != "") & (F.coalesce("doc_id", F.lit("")) != ""))


def flattened(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of rows that carry both; the first row of an id counts, queries get stable ids."""
    docs = corpus(df).groupBy("doc_id").agg(F.min(F.struct("title", "text")).alias("d")).select("doc_id", "d.title", "d.text")
    own = df.select(first_field(df, "_id", "id", "doc_id").alias("doc_id"), first_field(df, "query").alias("query")).where("doc_id is not null and query <> ''")
    own = own.withColumn("qid", F.concat(F.lit("q_"), F.md5("query")))
    return docs, own.select("qid", "query").distinct(), own.select("qid", "doc_id", F.lit(1).alias("rel")).distinct()


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def _head(spark: SparkSession, path: str, most: int = 65_536) -> str:
    """The first bytes of the first file of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    walk = fs.listFiles(p, True)
    while walk.hasNext():
        f = walk.next()
        if f.getLen() and not f.getPath().getName().startswith(("_", ".")):
            stream = fs.open(f.getPath())
            try:
                return bytes(stream.readNBytes(most)).decode(errors="ignore")
            finally:
                stream.close()
    return ""


def _entries(spark: SparkSession, path: str, separator: str, opens: str, closes: str, kind: T.DataType) -> DataFrame:
    """(key, value) of JSON objects that are cut at a separator, so that tasks share a large one.

    A piece has its separator's missing ends put back. Files with a piece that is no JSON then, since a
    string held the separator, are read whole, each as one row.
    """
    inside = F.regexp_replace(F.regexp_replace("value", r"^[\s,{]+", ""), r"[\s,]+$", "")
    pieces = spark.read.option("lineSep", separator).text(path).select(inside.alias("t"), F.input_file_name().alias("file")).where(~F.col("t").isin("", "}", "{"))
    pieces = pieces.select("file", F.from_json(F.concat(F.lit(opens), F.col("t"), F.when(F.endswith("t", F.lit("}")), F.lit("")).otherwise(F.lit(closes))), T.MapType(T.StringType(), kind)).alias("m"))
    odd = [r.file for r in pieces.where("m is null").select("file").distinct().collect()]
    out = pieces.where("m is not null")
    if odd:
        whole = spark.read.text(odd, wholetext=True).select(F.explode(F.filter(F.split("value", r"(?m)(?<=\})\s*$\s*(?=\{)"), lambda t: F.trim(t) != "")).alias("t"))
        out = out.where(~F.col("file").isin(odd)).select("m").unionByName(whole.select(F.from_json("t", T.MapType(T.StringType(), kind)).alias("m")))
    return out.select(F.explode("m").alias("key", "inner"))


def read_query_map(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query) of JSON objects {qid: text}, with an entry a line or all in one line.

    Lines are split over tasks, as no string of JSON holds a bare line end. An object in one line is split
    between a text's end and the next key.
    """
    head = _head(spark, path)
    separator = "\n" if "\n" in head.strip() else "\", \"" if "\", \"" in head else "\",\"" if "\",\"" in head else "\n"
    if separator == "\n":
        return _entries(spark, path, separator, "{", "}", T.StringType()).select(F.col("key").alias("qid"), F.col("inner").alias("query"))
    # the separator's quotes are the ends of a text and of the next key
    pieces = spark.read.option("lineSep", separator).text(path).select(F.input_file_name().alias("file"), F.trim(F.regexp_replace("value", r"\n$", "")).alias("t")).where("t <> ''")
    own = F.regexp_replace("t", r"^\{\s*\"", "")
    text = F.concat(F.lit('{"'), own, F.when(F.rlike("t", F.lit(r"\"\s*\}$")), F.lit("")).otherwise(F.lit('"}')))
    kind = T.MapType(T.StringType(), T.StringType())
    pieces = pieces.select("file", F.from_json(text, kind).alias("m"))
    odd = [r.file for r in pieces.where("m is null").select("file").distinct().collect()]
    out = pieces.where("m is not null")
    if odd:
        out = out.where(~F.col("file").isin(odd)).select("m").unionByName(spark.read.text(odd, wholetext=True).select(F.from_json("value", kind).alias("m")))
    return out.select(F.explode("m").alias("qid", "query"))


def read_qrels_map(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rel) of JSON objects {qid: {doc_id: grade}}, however they are laid out: tasks share them, cut behind each query's grades."""
    inner = T.MapType(T.StringType(), T.IntegerType())
    got = _entries(spark, path, "}", "{", "}}", inner)
    return got.select(F.col("key").alias("qid"), F.explode("inner").alias("doc_id", "rel"))


def read_beir(spark: SparkSession, root: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of three tables under a folder."""
    read = lambda name: spark.read.format(fmt).load(f"{root}/{name}")
    return corpus(read("corpus")), queries(read("queries")), qrels(read("qrels"))
