"""Intermediate tables in the shared folder: written once, read again, lineage cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, below a temporary folder (local master) or the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="evidence_") if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """df as a table in a new folder."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table of files over all tasks that run at once, where its files would keep less than a quarter of them busy.

    The texts of a small file are one task's otherwise. Other tables are read as their files are cut, and not moved.
    """
    spark = df.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(tasks) if 4 * size < tasks * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else df
