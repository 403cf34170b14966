"""Sinks: JSON lines, JSON maps, vectors and metric reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _objects(rows: DataFrame, path: str, parts: int, nested: bool) -> None:
    """Files that are one JSON object each, an entry a line, streamed from rows sorted by key: no map is ever held."""
    d = rows.repartitionByRange(parts, "qid").sortWithinPartitions(*rows.columns)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        text = lambda x: json.dumps(x, ensure_ascii=False)
        lines, before, key = [], None, None  # the last line waits to know what follows it
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                again = nested and before is not None and row[0] == key
                entry = f"{text(row[-2])}: {text(row[-1])}"
                lines.append("{" if before is None else before + ("," if again or not nested else "},"))
                before = entry if again or not nested else f"{text(row[0])}: {{{entry}"
                key = row[0]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
            lines = []
        if before is not None:
            yield pa.RecordBatch.from_arrays([pa.array([before + ("}" if nested else ""), "}"], pa.string())], ["value"])

    d.mapInArrow(write, "value string").write.mode("overwrite").text(path)


def write_query_map(queries: DataFrame, path: str, parts: int = 1) -> None:
    """JSON objects {qid: query}, a file for each of ``parts`` ranges of qid."""
    _objects(queries.select("qid", "query"), path, parts, nested=False)


def write_qrels_map(qrels: DataFrame, path: str, parts: int = 1) -> None:
    """JSON objects {qid: {doc_id: grade}}, a file for each of ``parts`` ranges of qid; a query's grades lie in one of them."""
    _objects(qrels.select("qid", "doc_id", "rel"), path, parts, nested=True)


def write_vectors(vectors: DataFrame, path: str, parts: int | None = None) -> None:
    """(chunk_id, embedding), sorted by chunk_id within range partitions (the session's number): look-ups by id prune files and row groups."""
    parts = parts or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors.select("chunk_id", "embedding").repartitionByRange(parts, "chunk_id").sortWithinPartitions("chunk_id").write.mode("overwrite").parquet(path)


def scalars(df: DataFrame) -> DataFrame:
    """Only the columns that JSON holds as plain values."""
    return df.select(*[c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "binary"))])


def metric_table(metrics: DataFrame, names: tuple[str, ...] = ("NDCG@10", "MAP@10", "Recall@10", "Recall@100", "MRR@10", "Precision@5")) -> DataFrame:
    """One row a stage, one column a metric, of (stage, metric, k, value)."""
    m = metrics.withColumn("name", F.concat("metric", F.lit("@"), F.col("k").cast("string")))
    return m.groupBy("stage").pivot("name", list(names)).agg(F.first("value"))


def merge_json(path: str, key: str, value: dict) -> dict:
    """Driver-side report: set a key of a JSON file, keeping the others."""
    try:
        with open(path) as f:
            report = json.load(f)
    except FileNotFoundError:
        report = {}
    report[key] = value
    with open(path, "w") as f:
        json.dump(report, f, indent=2, sort_keys=True)
    return report
