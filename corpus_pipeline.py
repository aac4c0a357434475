"""The corpus pipeline: five operators of quillmesh.llm applied to ``documents`` one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs; all but the last return the columns of ``documents``.

Defined cases: an empty table stays empty through all stages; null, empty and blank texts fail the quality rules and
go in the first stage, so that later ones meet texts of 20 words or more; texts may be as long as the operators take;
of repeated rows and texts that tie the one of least doc_id stays (nulls last); extra columns pass through every stage
but the last, whatever their names. A table is read again by a stage, so each stage's result is written; what a stage
wrote for itself, and its input, are removed once its result is there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm import bpe, decontaminate, near_dedup, quality, secret_scan
from quillmesh.llm.storage import mark, remove, shared_dir, sweep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the references are those of this stage's input."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the first by doc_id."""
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; all documents stay."""
    return secret_scan.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text of each document that is left."""
    return bpe.digest(docs)


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("encoding", encoding)]

#: Two stages (near duplicates by hashed candidates, BPE) are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        since = mark()
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{folder}/{i}-{name}")
        sweep(spark, since)
        docs = spark.read.schema(result.schema).parquet(f"{folder}/{i}-{name}")
        if i:
            remove(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
