"""Registered queries of the training-data operators and, where SQL expresses them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import digest

    return digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digest

    return digest(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import digest

    return digest(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import digest

    return digest(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import digest

    return digest(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import digest

    return digest(table(spark, sf_dir, "pages"))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pitman_yor import digest

    return digest(table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import digest

    return digest(table(spark, sf_dir, "documents"))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import digest

    return digest(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import digest

    return digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontaminate, op2_bpe, op3_near_dedup, op4_quality, op5_secrets, op6_html, op7_pitman_yor, op8_token_store, op9_token_count, op10_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    """The others are tested against brute force, the tokenizers library or held-out text in tests/llm."""
    from .oracles import ORACLES

    return dict(ORACLES)
