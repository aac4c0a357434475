"""Intermediate tables and the sizes that the operators go by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import collect, discard, mark, materialize, materialize_parts, remove, shared_dir, sweep

__all__ = ["collect", "discard", "least_hashes", "mark", "materialize", "materialize_parts", "parts", "remove", "shared_dir", "sweep"]


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session, for groups that this library numbers itself."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def least_hashes(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """At most n rows, those of the least hashes of keys: the sample that something is fitted on.

    Rows beyond twice the expected threshold are dropped before the sort, so that tasks send a few rows each and not n.
    """
    total = df.count()
    h = F.xxhash64(*keys)
    span = 1 << 40
    near = df if total <= 4 * n else df.where(F.pmod(h, F.lit(span)) < min(span, 2 * n * span // total + 1))
    return near.orderBy(F.pmod(h, F.lit(span)), h).limit(n)
