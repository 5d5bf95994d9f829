"""Retrieval quality against judged pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quality(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, recall, precision and reciprocal_rank at k of ranked (query_id, chunk_id, rank) against relevant (query_id, chunk_id)."""
    wanted = relevant.distinct()
    hits = ranked.where(F.col("rank") <= k).join(wanted, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"))
    all_ = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant")).join(hits, "query_id", "left").na.fill(0, ["hits"])
    return all_.select("query_id", (F.col("hits") / F.col("relevant")).alias("recall"), (F.col("hits") / F.lit(k)).alias("precision"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))
