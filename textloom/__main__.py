"""Command line: ``python -m textloom build | retrieve | evaluate``; tables are Parquet or JSON-lines folders."""

from __future__ import annotations

import argparse
import importlib
import time

from pyspark.sql import DataFrame, SparkSession

from .config import Config, from_yaml, pick_model
from .functions import text as T
from .operators.bm25 import query_tokens
from .operators.fusion import to_documents
from .operators.metrics import evaluate
from .plans import offline, retrieval
from .sources import readers
from .sources.versions import Stages, exists


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)


def _named(name: str | None):
    """The function that ``module:function`` names."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def encoder(spark: SparkSession, name: str | None, config: Config):
    """(frame encoder, what it is called): the one that ``name`` says, else the configured one with its fine-tuned or base model."""
    if name or not config.models.encoder:
        return _named(name), name or ""
    m = config.models
    path = pick_model(m.fine_tuned, m.base, m.use_fine_tuned, lambda p: bool(p) and exists(spark, p))
    return _named(m.encoder)(path), f"{m.encoder}({path})"


def build(spark: SparkSession, a: argparse.Namespace, config: Config) -> None:
    corpus, queries, qrels = readers.corpus(_read(spark, a.corpus)), readers.queries(_read(spark, a.queries)), readers.qrels(_read(spark, a.qrels))
    stages, (encode, model) = Stages(spark, a.index), encoder(spark, a.encoder, config)
    for name, df in offline.build(spark, corpus, queries, qrels, a.index, config, encode, model, stages).items():
        print(f"{name}: {df.count()} rows")
    for name, seconds in stages.seconds.items():
        print(f"stage {name}: {'made' if name in stages.made else 'kept'}, {seconds:.1f} s")


def retrieve(spark: SparkSession, a: argparse.Namespace, config: Config) -> None:
    """Refused queries are reported and take no part. Without an encoder: BM25 with texts."""
    queries, corpus = readers.queries(_read(spark, a.queries)), offline.load(spark, a.index)
    judged = queries.withColumn("problem", T.query_problem(queries["query"]))
    for r in judged.where("problem is not null").groupBy("problem").count().collect():
        print(f"{r['count']} queries refused: {r['problem']}")
    queries, encode = judged.where("problem is null").drop("problem"), encoder(spark, a.encoder, config)[0]
    if encode is None:
        got = retrieval.enrich(corpus.bm25.search(query_tokens(queries).select("qid", "tokens"), config.retrieval.top_k), corpus.chunks)
    else:
        got = retrieval.retrieve(corpus, queries, encode, config.retrieval)
    got.write.mode("overwrite").parquet(a.out)


def evaluation(spark: SparkSession, a: argparse.Namespace, config: Config) -> None:
    run, qrels = _read(spark, a.run), readers.qrels(_read(spark, a.qrels))
    if "score" not in run.columns:
        run = run.withColumnRenamed("ce_score", "score")
    docs = to_documents(run.select("qid", "chunk_id", "score"), run.select("chunk_id", "doc_id").distinct())
    evaluate(qrels, docs, config.evaluation.k_values, config.evaluation.mrr_k).orderBy("metric", "k").show(100, truncate=False)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="textloom", description=__doc__)
    p.add_argument("--config", help="YAML settings")
    commands = p.add_subparsers(dest="command", required=True)
    for name, run, needed in (("build", build, ("corpus", "queries", "qrels", "index")), ("retrieve", retrieve, ("index", "queries", "out")), ("evaluate", evaluation, ("run", "qrels"))):
        c = commands.add_parser(name)
        c.set_defaults(do=run)
        for x in needed:
            c.add_argument(f"--{x}", required=True)
        if name != "evaluate":
            c.add_argument("--encoder", help="module:function, a frame encoder")
    a = p.parse_args(args)
    spark, start = SparkSession.builder.appName("textloom").getOrCreate(), time.perf_counter()
    a.do(spark, a, from_yaml(a.config) if a.config else Config())
    print(f"{a.command}: {time.perf_counter() - start:.1f} s")


if __name__ == "__main__":
    main()
