"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only on one machine (a local master, as in tests) and where it is unset a temporary
    folder, which is then set; on a cluster an unset folder is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillmesh-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: its lineage ends there, and a lost
    executor costs a re-read rather than a recomputation. ``discard`` removes what is no longer needed."""
    return materialize_parts([df], name)


def materialize_parts(dfs: list[DataFrame], name: str) -> DataFrame:
    """Tables of the same columns as one, written one after another: the shuffle files of one go before those of the next
    are made, so that the disk has to hold those of one alone."""
    spark = dfs[0].sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    for i, df in enumerate(dfs):
        df.write.mode("append" if i else "errorifexists").option("compression", "zstd").parquet(path)
        if i + 1 < len(dfs):
            collect(spark)
    table = spark.read.schema(dfs[0].schema).parquet(path)
    table._scratch = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, whatever the store."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def collect(spark: SparkSession) -> None:
    """The shuffle files of past jobs go when the driver collects its garbage, which it may not do for long by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing lazy reads any more, and the shuffle files of their jobs."""
    for table in tables:
        remove(table.sparkSession, table._scratch)
        if table._scratch in _made:
            _made.remove(table._scratch)
    collect(tables[0].sparkSession)


def mark() -> int:
    """For ``sweep``: the tables made from now on."""
    return len(_made)


def sweep(spark: SparkSession, since: int) -> None:
    """Delete the tables that ``materialize`` has made since a mark and that are still there, once what was read from
    them is written."""
    while len(_made) > since:
        remove(spark, _made.pop())
    collect(spark)
