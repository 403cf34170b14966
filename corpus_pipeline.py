"""From raw documents to a training mix: each stage works on all that its predecessor kept.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame; all
but the last return the columns of documents. Thresholds are parameters of the operators; those that
differ from their defaults are set here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Stage, small_batches
from textloom.llm.decontamination import decontaminated
from textloom.llm.mixing import mix
from textloom.llm.quality_fm import fit, score
from textloom.llm.simhash_dedup import deduplicated
from textloom.llm.simhash_dedup import near_copies as verified_copies
from textloom.llm.suffix_dedup import without_repeats

#: Bytes of a repeated passage: 50 words take about 320, and hardly ever fewer than this.
PASSAGE = 250


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = docs.columns
    return score(docs, model, carry=tuple(c for c in names if c != "doc_id"), names=("_score", "_predicted")).where("_predicted = 1").select(*names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash candidates, verified at Jaccard similarity 0.8 of five-word shingles."""
    small_batches(spark)
    return deduplicated(docs, verified_copies)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that stand elsewhere too are cut from the texts; n_chars follows."""
    small_batches(spark)
    out = without_repeats(docs, length=PASSAGE)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and when."""
    return mix(docs)


STAGES = [("quality", quality), ("simhash", near_copies), ("suffix", passages), ("benchmark", benchmark), ("mixing", mixing)]
#: The classifier, fingerprints, repeated bytes and tiles have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and reread."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage.put(docs)
    return docs
