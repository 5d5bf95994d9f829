"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Keys are uniform, so the ranges of a sort by key are known
beforehand: the key's leading bits number a bucket of its source. Token counts are summed by bucket,
the buckets' sums are turned into prefix sums, and each bucket sorts its own rows, so no source is ever
in one task, however large. Rows before the source's budget are taken whole, the row on the border in
part, and whole epochs come first where the budget exceeds the source.

Defined results: null text counts 0 words; a null source is a source of its own, the last; sources
without words have target 0; repeated rows are documents of their own; texts of any length are counted
whole; an empty table gives no rows.
Other columns are kept by mixed() and not read by plan().
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.llm.common import n_words, written

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
#: Rows that one bucket of a source has at most, about; and the fewest leading bits.
BUCKET_ROWS, LEAST_BITS = 50_000, 8
#: Of the MD5 digest.
KEY_BITS = 60
KEYS = ["no_source", "src"]


def sized(docs: DataFrame, seed: int, bits: int) -> DataFrame:
    """Size, key and bucket of every document; the text is read here and nowhere else.

    The key is of doc_id and text, so that rows of one doc_id, or without any, are spread like others.
    """
    named = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    key = F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")
    return docs.select("doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).cast("string").alias("src"), n_words(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("tie")).withColumn(
        "bucket", F.shiftright("key", KEY_BITS - bits)
    )


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets of the sources (KEYS, source_size): shares by weight, none above most times its size.

    Sources stop at their caps in the order of cap over weight; the level at which the rest stands then
    follows from sums over that order. This table has a row for each source.
    """
    named = Window.orderBy(*KEYS)
    full = Window.orderBy("fills_at", *KEYS)
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(named) - 1) % len(weights) + 1)).withColumn("cap", F.col("source_size") * F.lit(most))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        weighed.withColumn("fills_at", F.col("cap") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    )
    level = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", *KEYS, "level"))).over(everything)["level"]
    return levels.select(*KEYS, "source_size", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def plan(docs: DataFrame, seed: int = 17, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """For every row: doc_id, no_source, src, key, tie, size, source_size, target, epochs (whole copies) and rest (words of one more)."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, docs.count()) / BUCKET_ROWS)))
    rows = written(sized(docs, seed, bits), "mix-sizes")
    buckets = rows.groupBy(*KEYS, "bucket").agg(F.sum("size").alias("bucket_size"))
    goal = targets(buckets.groupBy(*KEYS).agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy(*KEYS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size").join(goal, KEYS)
    in_bucket = Window.partitionBy(*KEYS, "bucket").orderBy("key", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.round("target").cast("long")
    return (
        rows.withColumn("before", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
        .join(offsets, [*KEYS, "bucket"])
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(round(target) as long) div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("epochs") * F.col("source_size") - F.col("before") - F.col("offset"))))
        .select("doc_id", *KEYS, "key", "tie", "size", "source_size", "target", "epochs", "rest")
    )


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row."""
    return plan(docs, **options).select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("epochs") * F.col("size") + F.col("rest")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: whole copies of each row, then its part, up to the source's budget; columns as in docs.

    A part is the text's first words as far as the budget goes; at most one row of a source has one that
    is not its whole text.
    """
    columns = docs.columns
    todo = plan(docs, **options).where("epochs > 0 or rest > 0").select("doc_id", "tie", "size", "epochs", "rest")
    # rows that are alike in everything share their copies: they are as good as each other
    todo = todo.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("size", "epochs", "rest")).alias("copies"))
    rows = docs.withColumn("tie", F.xxhash64("text"))
    one = Window.partitionBy("doc_id", "tie").orderBy(F.hash(*columns), *[c for c in columns if c not in ("doc_id", "text")])
    rows = rows.withColumn("nth", F.row_number().over(one))
    chosen = rows.alias("d").join(todo.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.tie").eqNullSafe(F.col("t.tie")))
    piece = F.get("copies", F.col("nth") - 1)
    whole = F.expr("transform(sequence(1, cast(piece.epochs as int), 1), i -> piece.size)")
    parts = F.concat(F.when(F.col("piece.epochs") > 0, whole).otherwise(F.array().cast("array<long>")), F.when(F.col("piece.rest") > 0, F.array("piece.rest")).otherwise(F.array().cast("array<long>")))
    cut = F.when(F.col("words") >= F.col("piece.size"), F.col("d.text")).otherwise(F.array_join(F.slice(F.regexp_extract_all(F.col("d.text"), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)), 1, F.greatest(F.lit(1), F.col("words").cast("int"))), " "))
    return chosen.withColumn("piece", piece).where("piece is not null").withColumn("words", F.explode(parts)).select(*[cut.alias("text") if c == "text" else F.col(f"d.{c}") for c in columns])
