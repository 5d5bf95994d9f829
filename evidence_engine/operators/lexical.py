"""BM25 over an inverted index kept as plain tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions.text import references, same, search_form, tokens
from evidence_engine.sources.scratch import written


@dataclass(frozen=True)
class BM25:
    k1: float = 1.5
    b: float = 0.75
    top_k: int = 10
    document_boost: float = 4.0
    article_boost: float = 10.0
    clause_boost: float = 6.0
    point_boost: float = 3.0


FIELDS = ("document_id", "article", "clause", "point")


def searchable(text: Column, *metadata: Column) -> Column:
    """Text and the metadata that count as text."""
    return F.concat_ws("\n", F.coalesce(text, F.lit("")), *[F.coalesce(m, F.lit("")) for m in metadata])


def term_frequencies(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(chunk_id, term, tf, dl): one shuffle on (chunk_id, term); dl rides along."""
    rows = chunks.select("chunk_id", tokens(F.col(text)).alias("t"))
    return rows.select("chunk_id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term")).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def lengths(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.select("chunk_id", F.size(tokens(F.col(text))).cast("long").alias("dl"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(dl: DataFrame) -> DataFrame:
    """One row: n and avgdl."""
    return dl.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.ln(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), each term once."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


def matched(chunks: DataFrame, queries: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Postings of the questions' terms, and the corpus' statistics, in one pass over texts.

    Each chunk's tokens, and one empty one that stands for the chunk itself, meet the terms in the task that
    read it (terms are few, so Spark broadcasts them; otherwise it moves tokens); only what is left is
    counted and moved. It is written, as frequencies, scores and statistics all go back to it.
    """
    wanted = query_terms(queries).select("term").distinct().unionByName(queries.sparkSession.range(1).select(F.lit("").alias("term")))
    rows = chunks.select("chunk_id", tokens(F.col(text)).alias("t"))
    rows = rows.select("chunk_id", F.size("t").cast("long").alias("dl"), F.explode(F.concat("t", F.array(F.lit("")))).alias("term")).join(wanted, "term", "left_semi")
    found = written(rows.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")), "matched")
    return found.where("term <> ''"), corpus_stats(found.where("term = ''"))


def scores(postings: DataFrame, stats: DataFrame, queries: DataFrame, config: BM25 = BM25()) -> DataFrame:
    """(query_id, chunk_id, bm25_score), rounded.

    Postings meet the questions' terms before anything else is joined, so only their lists move; a list's
    df is the number of its rows there. stats is one row, a scalar in the plan.
    """
    terms = query_terms(queries)
    lists = postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = document_frequencies(lists)
    n, avgdl = stats.select("n").scalar(), stats.select("avgdl").scalar()
    weighed = df.select("term", idf(n, F.col("df")).alias("idf"))
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("idf") * tf * F.lit(config.k1 + 1) / (tf + F.lit(config.k1) * (F.lit(1 - config.b) + F.lit(config.b) * dl / avgdl))
    rows = lists.join(weighed, "term").select("term", "chunk_id", part.alias("part"))
    return rows.join(terms, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("bm25_score"))


def with_references(queries: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Adds want_document_id, want_article, want_clause and want_point.

    A question that names the land law and a year but no number means the only document with that year
    whose title has the law's name and isn't the amending law's; documents: document_id, document_title.
    """
    refs = references(F.col("query"))
    out = queries.withColumns({f"want_{k}": v for k, v in refs.items()})
    if documents is None:
        return out
    plain = search_form(F.col("query"))
    year = F.when(F.contains(plain, F.lit("luật đất đai")), F.nullif(F.regexp_extract(plain, r"(?U)\b((?:19|20)[0-9]{2})\b", 1), F.lit("")))
    asked = out.where("want_document_id is null").select("query_id", year.alias("year")).where("year is not null")
    title = search_form(F.col("document_title"))
    # few documents have the law's name in their title; the years of questions are fewer still
    named = documents.select("document_id", "document_title").distinct().where(F.contains(title, F.lit("luật đất đai")) & ~title.startswith("luật số 43")).select("document_id").distinct()
    meant = asked.join(named, F.contains(F.col("document_id"), F.col("year"))).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("meant")).where("n = 1").drop("n")
    return out.join(meant, "query_id", "left").withColumn("want_document_id", F.coalesce("want_document_id", "meant")).drop("meant")


def boost(config: BM25 = BM25()) -> Column:
    """What exact references add, from columns FIELDS and want_*."""
    worth = dict(zip(FIELDS, (config.document_boost, config.article_boost, config.clause_boost, config.point_boost), strict=True))
    return sum((F.when(same(F.col(k), F.col(f"want_{k}")), F.lit(v)).otherwise(F.lit(0.0)) for k, v in worth.items()), F.lit(0.0))


def boosted(queries: DataFrame, metadata: DataFrame, config: BM25 = BM25()) -> DataFrame:
    """(query_id, chunk_id, metadata_boost) of chunks that match a reference; an equality join for each kind."""
    found = None
    for k in FIELDS:
        asked = queries.where(F.col(f"want_{k}").isNotNull()).select("query_id", search_form(F.col(f"want_{k}")).alias("key"))
        hits = metadata.select("chunk_id", search_form(F.col(k)).alias("key")).join(asked, "key").select("query_id", "chunk_id")
        found = hits if found is None else found.unionByName(hits)
    rows = found.distinct().join(queries.select("query_id", *[f"want_{k}" for k in FIELDS]), "query_id").join(metadata.select("chunk_id", *FIELDS), "chunk_id")
    return rows.select("query_id", "chunk_id", boost(config).alias("metadata_boost"), *[same(F.col(k), F.col(f"want_{k}")).alias(f"match_{k}") for k in FIELDS])


def ranked(found: DataFrame, top_k: int | None, config: BM25 = BM25()) -> DataFrame:
    """The best by (score, bm25_score, chunk_id), all falling; 0 and None mean the default."""
    if top_k is not None and top_k < 0:
        raise ValueError("top_k must not be negative")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("bm25_score"), F.desc("chunk_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= (top_k or config.top_k)).withColumn("rank", F.col("rank").cast("long"))


def search(postings: DataFrame, stats: DataFrame, queries: DataFrame, metadata: DataFrame | None = None, top_k: int | None = None, config: BM25 = BM25()) -> DataFrame:
    """query_id, rank, chunk_id, bm25_score, metadata_boost and score of each question's best chunks."""
    text = scores(postings, stats, queries, config)
    if metadata is None:
        found = text.withColumn("metadata_boost", F.lit(0.0))
    else:
        found = text.join(boosted(queries, metadata, config).select("query_id", "chunk_id", "metadata_boost"), ["query_id", "chunk_id"], "full").na.fill(0.0, ["bm25_score", "metadata_boost"])
    found = found.withColumn("score", F.round(F.col("bm25_score") + F.col("metadata_boost"), 6)).where("score > 0")
    return ranked(found, top_k, config).select("query_id", "rank", "chunk_id", "bm25_score", "metadata_boost", "score")
