"""The opN queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import CHAT_SQL, digests, fingerprinted, formatted, frame_turns, record_turns
from .common import crc_bucket, small_batches
from .decontamination import leaks
from .fill_in_middle import FIM_SQL, fill_in_middle, restored
from .license_scan import SCAN_SQL, scan
from .mixing import MIX_SQL, mix
from .ngram_automaton import score_texts
from .onebit_ann import NEAREST_SQL, nearest
from .quality_fm import fit, score
from .simhash_dedup import near_duplicates
from .suffix_dedup import kept_digests
from .token_counts import token_counts
from .url_graph import judge
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, _table(spark, sf_dir, "labels")), threshold=0.3)
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_digests(_table(spark, sf_dir, "documents"), length=400)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.element_at("lanes", 1)), 16, "0")).alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "positions", "position")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    made = restored(fill_in_middle(_table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whiten(_table(spark, sf_dir, "embeddings"), components=8)
    rows = made.select("vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c"))
    return rows.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows are turns; conversation -1 comes as a record of another layout."""
    said = "</s>[INST] ok [/INST]"
    record = spark.createDataFrame([(-1, json.dumps({"prompt": said, "response": said}))], "conv_id long, record string")
    turns = frame_turns(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id")
    made = digests(formatted(turns.unionByName(record_turns(fingerprinted(record, "conv_id", "record")))))
    return made.withColumnRenamed("key", "conv_id")


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality, op3_lm_scores, op4_license_scan, op5_url_filter, op6_suffix_dedup, op7_decontamination, op8_nearest, op9_simhash, op10_mixing, op11_fill_in_middle, op12_whitening, op13_chat_format)}
SQL = {"op4_license_scan": SCAN_SQL, "op8_nearest": NEAREST_SQL, "op10_mixing": MIX_SQL, "op11_fill_in_middle": FIM_SQL, "op13_chat_format": CHAT_SQL}
