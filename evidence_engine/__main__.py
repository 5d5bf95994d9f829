"""spark-submit entry: clean, parse, build and query."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine import config as settings
from evidence_engine import engine
from evidence_engine.operators import cleaning, structure
from evidence_engine.sources import docx, files, tables


def named(path: str):
    """A callable by module:name."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def arguments(argv: list[str] | None):
    parser = argparse.ArgumentParser(prog="evidence_engine")
    todo = parser.add_subparsers(dest="command", required=True)
    p = todo.add_parser("clean", help="DOCX files to tables of lines, statistics and what was removed")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--texts", action="store_true", help="also a .txt and a .stats.json for each document, and manifest.json")
    p = todo.add_parser("parse", help="lines (a folder of clean's, or a manifest.json) to facts, chunks and a report")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--max-chars", type=int)
    p.add_argument("--json", action="store_true", help="also structured_documents.json, chunks.json and parsing_report.json")
    p = todo.add_parser("build", help="chunks to a lexical index, and with an encoder to a dense one")
    p.add_argument("input")
    p.add_argument("output")
    p = todo.add_parser("query", help="questions to a stored index")
    p.add_argument("index")
    p.add_argument("query", nargs="+")
    p.add_argument("--method", choices=("lexical", "dense", "hybrid"), default="lexical")
    p.add_argument("--top-k", type=int)
    for p in todo.choices.values():
        p.add_argument("--config", help="a YAML file")
        p.add_argument("--encoder", help="module:function that turns a list of texts into vectors")
    return parser.parse_args(argv)


def clean(spark: SparkSession, args) -> None:
    blocks = docx.read(spark, args.input)
    rows, margins = docx.lines(blocks), docx.margins(blocks)
    cleaning.clean_lines(rows).write.mode("overwrite").parquet(f"{args.output}/lines")
    cleaning.removal_log(rows, margins).write.mode("overwrite").parquet(f"{args.output}/removal_log")
    facts = blocks.groupBy("document_id", "path", "sha256").agg(F.count_if(F.col("kind") == "paragraph").alias("paragraphs"), F.count_if(F.col("kind") == "table_row").alias("table_rows"))
    stats = cleaning.cleaning_stats(rows, margins).join(facts, "document_id")
    stats.orderBy(F.lower("document_id"), "document_id").write.mode("overwrite").parquet(f"{args.output}/manifest")
    if args.texts:
        files.write_texts(spark.read.parquet(f"{args.output}/lines"), spark.read.parquet(f"{args.output}/manifest"), f"{args.output}/texts")


def parse(spark: SparkSession, args, config: settings.Config) -> None:
    lines = files.read_manifest(spark, args.input) if args.input.endswith(".json") else spark.read.parquet(f"{args.input}/lines")
    lines = lines.withColumn("source_file", F.col("document_id")).withColumn("document_id", structure.document_number_of(F.col("document_id")))
    if not lines.where("document_id is null").isEmpty():
        raise SystemExit("a file's name has no document number")
    structure.parse(lines).write.mode("overwrite").parquet(f"{args.output}/facts")
    facts = spark.read.parquet(f"{args.output}/facts")
    structure.chunks(facts, args.max_chars or config.max_chars).write.mode("overwrite").parquet(f"{args.output}/chunks")
    chunks = spark.read.parquet(f"{args.output}/chunks")
    structure.report(facts, chunks).write.mode("overwrite").parquet(f"{args.output}/report")
    if args.json:
        by_document = facts.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("line_no", *[c for c in facts.columns if c not in ("document_id", "line_no")]))).alias("lines"))
        files.write_array(by_document.orderBy("document_id"), f"{args.output}/structured_documents.json")
        files.write_array(chunks.orderBy("document_id", "chunk_pos"), f"{args.output}/chunks.json")
        files.write_array(spark.read.parquet(f"{args.output}/report").orderBy("document_id"), f"{args.output}/parsing_report.json")


def retriever(spark: SparkSession, args, config: settings.Config) -> tuple[engine.Retriever, DataFrame]:
    postings, stats, chunks = tables.load_lexical(spark, f"{args.index}/lexical")
    if "year" not in chunks.columns:
        chunks = chunks.withColumn("year", F.lit(None).cast("string"))
    lexical = engine.LexicalRetriever(postings, stats, chunks, config.lexical)
    if args.method == "lexical":
        return lexical, chunks
    if not args.encoder:
        raise SystemExit(f"{args.method} search needs an --encoder")
    dense = engine.DenseRetriever(tables.load_dense(spark, f"{args.index}/dense", chunks), named(args.encoder), config.dense.query_prefix)
    return (dense if args.method == "dense" else engine.HybridRetriever(lexical, dense, chunks, config.hybrid)), chunks


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    config = settings.load(args.config) if args.config else settings.Config()
    spark = SparkSession.builder.appName("evidence_engine").getOrCreate()
    if args.command == "clean":
        clean(spark, args)
    elif args.command == "parse":
        parse(spark, args, config)
    elif args.command == "build":
        encode = named(args.encoder) if args.encoder else None
        print(json.dumps(engine.build(spark.read.parquet(f"{args.input}/chunks"), args.output, encode, spark.read.parquet(f"{args.input}/report"), config.dense.passage_prefix)))
    else:
        found, chunks = retriever(spark, args, config)
        k = args.top_k or {"lexical": config.lexical.top_k, "dense": config.dense.top_k, "hybrid": config.hybrid.final_top_k}[args.method]
        asked = spark.createDataFrame(list(enumerate(args.query, 1)), "query_id long, query string")
        rows = found.search(asked, k)
        rows = rows.select("query_id", "chunk_id", "rank", "score").join(chunks.select("chunk_id", "text"), "chunk_id").orderBy("query_id", "rank")
        for row in rows.limit(k * len(args.query)).toJSON().collect():
            print(row)


if __name__ == "__main__":
    main()
