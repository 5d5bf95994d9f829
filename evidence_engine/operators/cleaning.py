"""Cleaning of line tables (document_id, line_no, text): what stays, what goes and why, and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions.text import is_page_number, line_form


def lines_of(docs: DataFrame, document_id: str = "document_id", text: str = "text") -> DataFrame:
    """A row for each line of each text, numbered from 1."""
    return docs.select(F.col(document_id).alias("document_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at", "text")).select("document_id", (F.col("at") + 1).cast("long").alias("line_no"), "text")


def table_line(cells) -> F.Column:
    """A table row as one line: normal forms, empty cells and repeats of the cell before left out; null if nothing is left."""
    plain = F.filter(F.transform(cells, lambda c: F.translate(line_form(c), "\n", " ")), lambda c: c != "")
    kept = F.aggregate(plain, F.array().cast("array<string>"), lambda a, c: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) == c), a).otherwise(F.concat(a, F.array(c))))
    return F.when(F.size(kept) > 0, F.array_join(kept, " | "))


def judged(lines: DataFrame) -> DataFrame:
    """Adds reason: null for lines that stay, else empty, page_number or consecutive_duplicate.

    A line repeats the last kept one exactly if it equals the one before it among those that are neither
    empty nor page numbers, so one lag over these decides.
    """
    rows = lines.withColumn("text", line_form(F.col("text")))
    first = F.when(F.coalesce("text", F.lit("")) == "", F.lit("empty")).when(is_page_number(F.col("text")), F.lit("page_number"))
    rows = rows.withColumn("first", first)
    before = F.lag("text").over(Window.partitionBy("document_id", F.col("first").isNull()).orderBy("line_no"))
    return rows.withColumn("reason", F.when(F.col("first").isNotNull(), F.col("first")).when(F.col("text").eqNullSafe(before), F.lit("consecutive_duplicate"))).drop("first")


def clean_lines(lines: DataFrame) -> DataFrame:
    """The lines that stay, numbered anew from 1."""
    kept = judged(lines).where("reason is null")
    return kept.select("document_id", F.row_number().over(Window.partitionBy("document_id").orderBy("line_no")).cast("long").alias("line_no"), "text")


def removal_log(lines: DataFrame, margins: DataFrame | None = None) -> DataFrame:
    """reason, text and line of what went; of margins (document_id, text: headers and footers) reason, text and count."""
    rows = judged(lines).where("reason in ('page_number', 'consecutive_duplicate')").select("document_id", "reason", "text", F.col("line_no").alias("line"), F.lit(None).cast("long").alias("count"))
    if margins is None:
        return rows
    counted = margins.groupBy("document_id", "text").agg(F.count(F.lit(1)).alias("count"))
    return rows.unionByName(counted.select("document_id", F.lit("header_footer").alias("reason"), "text", F.lit(None).cast("long").alias("line"), "count"))


def cleaning_stats(lines: DataFrame, margins: DataFrame | None = None) -> DataFrame:
    rows = judged(lines)
    of = lambda reason: F.count_if(F.col("reason") == reason)
    out = rows.groupBy("document_id").agg(of("empty").alias("empty_lines_removed"), of("page_number").alias("page_number_lines_removed"), of("consecutive_duplicate").alias("duplicate_lines_removed"), F.count_if(F.col("reason").isNull()).alias("output_line_count"))
    if margins is None:
        out = out.withColumn("header_footer_lines_excluded", F.lit(0).cast("long"))
    else:
        out = out.join(margins.groupBy("document_id").agg(F.count(F.lit(1)).alias("header_footer_lines_excluded")), "document_id", "left").na.fill(0, ["header_footer_lines_excluded"])
    return out.withColumn("removed_line_count", F.col("empty_lines_removed") + F.col("page_number_lines_removed") + F.col("duplicate_lines_removed") + F.col("header_footer_lines_excluded"))
