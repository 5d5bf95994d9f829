"""New text files into a table of clean lines, as they come: each run takes what is there and ends."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evidence_engine.operators.cleaning import clean_lines, lines_of


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str):
    """Clean the files of folder that no earlier run has seen and append (document_id, line_no, text) to a Parquet table."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("document_id"), F.col("value").alias("text"))

    def add(batch, number):
        clean_lines(lines_of(batch)).write.mode("append").parquet(table)

    query = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
