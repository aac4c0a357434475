"""Checks of result files as one table of findings: (rule, severity, n, examples)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_ids
from .diagnostics import union_all

EXAMPLES = 5


def _finding(rows: DataFrame, rule: str, severity: str, key: str = "key") -> DataFrame:
    """One row for a rule: how many offenders, and the first few of them in order."""
    few = rows.select(F.col(key).cast("string").alias("key")).distinct().orderBy("key").limit(EXAMPLES).agg(F.array_join(F.sort_array(F.collect_list("key")), ",").alias("examples"))
    return rows.agg(F.count("*").alias("n")).crossJoin(few).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "examples")  # one row each


def list_findings(rows: DataFrame, required: DataFrame, valid: DataFrame | None = None, name: str = "matching") -> DataFrame:
    """Findings on rows (q_id, ids: a comma-joined cell, null for a row without one) against the required q_ids."""
    ids = rows.select("q_id", F.explode(parse_ids("ids")).alias("id"))
    raw = F.filter(F.split(F.coalesce("ids", F.lit("")), ","), lambda x: F.trim(x) != "")
    checks = [
        _finding(rows.where(F.col("ids").isNull() & (F.trim("q_id") != "")), f"{name}: row without tab", "error", "q_id"),
        _finding(rows.groupBy("q_id").count().where("count > 1"), f"{name}: duplicate row", "error", "q_id"),
        _finding(rows.where(F.size(raw) > F.size(F.array_distinct(F.transform(raw, lambda x: F.trim(x))))), f"{name}: repeated id", "error", "q_id"),
        _finding(ids.where(F.col("id").startswith("S1-")), f"{name}: match in source 1", "error", "id"),
        _finding(ids.where(~F.col("id").rlike("^S[123]-")), f"{name}: bad prefix", "error", "id"),
        _finding(required.select("q_id").distinct().join(rows, "q_id", "left_anti"), f"{name}: missing row", "error", "q_id"),
        _finding(rows.select("q_id").distinct().join(required, "q_id", "left_anti"), f"{name}: unexpected row", "error", "q_id"),
    ]
    if valid is not None:
        checks.append(_finding(ids.where(F.col("id").rlike("^S[23]-")).join(valid, "id", "left_anti"), f"{name}: unknown id", "error", "id"))
    return union_all(checks)


def file_findings(spark: SparkSession, path: str, name: str = "matching") -> DataFrame:
    """Findings on the file itself: no rows at all, no header of entity ids, commas in place of tabs."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.col("value").alias("key"))
    header = F.lower(F.col("key")).startswith("source1_entity_id")
    n, heads, tabs, commas = lines.agg(F.count("*"), F.count(F.when(header, 1)), F.count(F.when(F.col("key").contains("\t"), 1)), F.count(F.when(~F.col("key").contains("\t") & F.col("key").rlike("^[^,]+,S[0-9]+-"), 1))).first()
    rules = [(n == 0, "empty file"), (n > 0 and heads == 0, "no header"), (heads > 1, "repeated header"), (n > 0 and tabs == 0 and commas > 0, "commas in place of tabs")]
    rows = [(f"{name}: {rule}", "error", 1, path) for found, rule in rules if found]
    return spark.createDataFrame(rows, "rule string, severity string, n long, examples string")


def validate(matching: DataFrame, candidates: DataFrame | None, required: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """All rules with at least one offender; matches outside the candidates are a warning."""
    parts = [list_findings(matching, required, valid)]
    if candidates is None:
        spark = matching.sparkSession
        parts.append(spark.createDataFrame([("candidates: no file", "warning", 1, "")], "rule string, severity string, n long, examples string"))
    else:
        parts.append(list_findings(candidates, required, valid, "candidates"))
        m = matching.select("q_id", F.explode(parse_ids("ids")).alias("id")).distinct()
        c = candidates.select("q_id", F.explode(parse_ids("ids")).alias("id")).distinct()
        parts.append(_finding(m.join(c, ["q_id", "id"], "left_anti").select("q_id").distinct(), "match outside candidates", "warning", "q_id"))
    return union_all(parts).where("n > 0")
