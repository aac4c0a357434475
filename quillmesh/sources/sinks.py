"""Sinks: Parquet written once, unquoted TSV, result files and manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_once(df: DataFrame, path: str) -> None:
    """zstd Parquet, left as it is where it exists."""
    df.write.option("compression", "zstd").mode("ignore").parquet(path)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    """Tabs, no quotes, empty strings as nothing, line feeds."""
    df.write.option("sep", "\t").option("header", header).option("quote", "").option("emptyValue", "").option("nullValue", "").option("lineSep", "\n").mode("overwrite").csv(path)


def write_truth(df: DataFrame, truth_path: str, meta_path: str) -> None:
    """Split ids (q_id, matched, country, bucket) as a truth table and a meta table."""
    write_tsv(df.select(F.col("q_id").alias("source1_entity_id"), F.col("matched").alias("matched_entity_ids")), truth_path)
    write_tsv(df.select(F.col("q_id").alias("source1_entity_id"), "country", "bucket"), meta_path)


def write_results(rows: DataFrame, folder: str, n_queries: int) -> None:
    """Matching, candidate and score files of submission rows (q_id, matched, candidates, scores, candidate order)."""
    rows = rows.cache()
    if (n := rows.count()) != n_queries:
        raise ValueError(f"{n} rows for {n_queries} queries")
    name = F.col("q_id").alias("source1_entity_id")
    write_tsv(rows.select(name, F.col("matched").alias("matched_entity_ids")), f"{folder}/matching_results.tsv")
    write_tsv(rows.select(name, F.col("candidates").alias("candidate_entity_ids")), f"{folder}/candidate_pairs.tsv")
    pairs = F.arrays_zip(F.split("candidates", ",").alias("i"), F.split("scores", ",").alias("s"))
    taken = F.filter(pairs, lambda x: F.array_contains(F.split("matched", ","), x["i"]) & (x["i"] != ""))
    scored = F.array_join(F.transform(taken, lambda x: F.concat_ws(":", x["i"], x["s"])), ",")
    write_tsv(rows.select("q_id", scored.alias("scores")), f"{folder}/accepted_scores.tsv", header=False)
    rows.unpersist()


def write_json(spark: SparkSession, values: dict, path: str) -> None:
    """A small JSON document (a rule, a manifest)."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
