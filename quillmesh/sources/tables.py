"""Scans. Schemas are declared, never inferred; an empty cell is an empty string."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_ids


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A tab-delimited table with a header and double quotes, all columns strings, in the order of the file."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').schema(schema).csv(path)
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def source_path(root: str, split: str, src: int) -> str:
    return f"{root}/{split}/{split}_source{src}.tsv"


def load_source(spark: SparkSession, root: str, split: str, src: int, columns: list[str] | None = None) -> DataFrame:
    """entity_id, business_name, business_address and country of one source, with its number; or some of them."""
    df = read_tsv(spark, source_path(root, split, src), ["entity_id", "business_name", "business_address", "country"])
    return df.select(*(columns or df.columns)).withColumn("src", F.lit(src))


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    """(q_id, matched, ids) of a truth table."""
    df = read_tsv(spark, path, ["source1_entity_id", "matched_entity_ids"])
    return df.select(F.col("source1_entity_id").alias("q_id"), F.col("matched_entity_ids").alias("matched"), parse_ids("matched_entity_ids").alias("ids"))


def truth_pairs(truth: DataFrame) -> DataFrame:
    return truth.select("q_id", F.explode("ids").alias("rec_id"))


def load_queries(records: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """Records of source 1, those of a subset (entity_id) if given."""
    q = records.where("src = 1")
    return q if subset is None else q.join(subset.select("entity_id"), "entity_id", "left_semi")


def load_dense(spark: SparkSession, path: str, k: int, only: DataFrame | None = None) -> DataFrame:
    """Dense lists cut to k, for some queries (q_id) if given."""
    df = spark.read.parquet(path).where(F.col("rank") < k)
    return df if only is None else df.join(only.select("q_id"), "q_id", "left_semi")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(q_id, ids) of a list file without quoting: what is before the first tab and after it; ids null without a tab."""
    df = spark.read.text(path).where("value <> ''")
    tab = F.instr("value", "\t")
    return df.select(F.when(tab > 0, F.substring_index("value", "\t", 1)).otherwise(F.col("value")).alias("q_id"), F.when(tab > 0, F.expr("substring(value, instr(value, '\t') + 1)")).alias("ids"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(q_id, rec_id, score) of a file of id:score lists; the score is after the last colon."""
    cells = read_lines(spark, path).select("q_id", F.explode(F.filter(F.split(F.coalesce("ids", F.lit("")), ","), lambda x: x != "")).alias("x"))
    return cells.select("q_id", F.regexp_extract("x", "^(.*):([^:]*)$", 1).alias("rec_id"), F.regexp_extract("x", "^(.*):([^:]*)$", 2).cast("double").alias("score"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): trimmed first column of a table with a header, blanks left out."""
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return df.select(F.trim(df.columns[0]).alias("id")).where("id <> ''")


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON file, through Spark so that any store will do."""
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))
