"""Queries over the driver tables: documents stand in for chunks, source for the document, lang for article and version."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_engine.functions import vocabulary as V
from evidence_engine.functions.text import prefixed, search_form
from evidence_engine.operators import cleaning, dense, evaluation, evidence, fusion, lexical, structure
from evidence_engine.plans.registry import query
from evidence_engine.sources import tables
from evidence_engine.sources.scratch import folder, spread, written
from evidence_engine.sources.tables import chunk_violations

TERMS = "the of tion thing ention erand"
YEARS = {"fr": "2013", "en": "2024", "de": "2025"}


def docs(spark, sf):
    return spread(spark.read.parquet(f"{sf}/documents.parquet"))


def chunks(spark, sf):
    """documents as chunks."""
    year = F.create_map(*[F.lit(x) for p in YEARS.items() for x in p])
    return docs(spark, sf).select(
        F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("source").alias("document_id"), F.lit(None).cast("string").alias("document_title"), F.col("lang").alias("article"),
        F.try_element_at(year, F.col("lang")).alias("year"), F.col("doc_id").alias("chunk_pos"), F.lit(None).cast("string").alias("source_file"),
    )


def lines(spark, sf):
    return cleaning.lines_of(docs(spark, sf), "doc_id")


def questions(spark, sf):
    """The benchmark's texts, some with a version or a comparison in words."""
    more = F.when(F.col("item_id") % 3 == 1, " theo luật 2013").when(F.col("item_id") % 3 == 2, " so sánh 2013 2024").otherwise("")
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.concat("text", more).alias("query"))


def postings(spark, sf):
    return lexical.term_frequencies(chunks(spark, sf))


def stats(spark, sf):
    return lexical.corpus_stats(lexical.lengths(chunks(spark, sf)))


def lexical_hits(spark, sf, k):
    asked = questions(spark, sf)
    lists, facts = lexical.matched(chunks(spark, sf), asked)
    rows = lexical.search(lists, facts, asked, top_k=k)
    return rows.select("query_id", "chunk_id", "rank", F.col("bm25_score").alias("score"))


def dense_hits(spark, sf, k):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = vectors.join(questions(spark, sf).select(F.col("query_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.search(vectors, asked, k).select("query_id", F.col("vec_id").cast("string").alias("chunk_id"), "rank", F.col("vector_score").alias("score"))


LINES = r"""
  raw as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) line_no from documents),
  norm as (select doc_id, line_no, regexp_replace(regexp_replace(replace(replace(replace(line, chr(8203), ''), chr(160), ' '), chr(13), chr(10)), '[ \t\f\v]+', ' ', 'g'), '^\s+|\s+$', '', 'g') as text from raw),
  first as (select *, case when text = '' then 'empty'
    when regexp_full_match(text, '(?i)\s*(?:[-–—]\s*[0-9]{1,4}\s*[-–—]|(?:trang|page)\s+[0-9]{1,4}(?:\s*/\s*[0-9]{1,4})?)\s*') then 'page_number' end r from norm),
  judged as (select doc_id, line_no, text, coalesce(r, case when text = lag(text) over (partition by doc_id, r is null order by line_no) then 'consecutive_duplicate' end) reason from first)"""


@query("clean_lines", f"with {LINES} select doc_id as document_id, (row_number() over (partition by doc_id order by line_no))::bigint line_no, text from judged where reason is null")
def clean_lines(spark, sf):
    return cleaning.clean_lines(lines(spark, sf))


@query("removal_log", f"with {LINES} select doc_id as document_id, reason, text, line_no::bigint as line from judged where reason in ('page_number', 'consecutive_duplicate')")
def removal_log(spark, sf):
    return cleaning.removal_log(lines(spark, sf)).drop("count")


@query("cleaning_stats", f"""with {LINES} select doc_id as document_id, count(*) filter (reason = 'empty')::bigint empty_lines_removed, count(*) filter (reason = 'page_number')::bigint page_number_lines_removed,
  count(*) filter (reason = 'consecutive_duplicate')::bigint duplicate_lines_removed, count(*) filter (reason is null)::bigint output_line_count, 0::bigint header_footer_lines_excluded,
  count(*) filter (reason is not null)::bigint removed_line_count from judged group by doc_id""")
def cleaning_stats(spark, sf):
    return cleaning.cleaning_stats(lines(spark, sf))


INDEX = r"""
  tok as (select doc_id::varchar chunk_id, regexp_extract_all(lower(nfc_normalize(text)), '[0-9]{1,4}[/-][0-9]{4}[/-]qh[0-9]+|[0-9]+[a-z]?|\p{L}+') t from documents),
  dl as (select chunk_id, len(t)::bigint dl from tok),
  post as (select chunk_id, term, count(*)::bigint tf from (select chunk_id, unnest(t) term from tok) group by all),
  stats as (select count(*)::bigint n, avg(dl) avgdl from dl),
  df as (select term, count(*)::bigint df from post group by term)"""
SCORES = """
  scored as (select query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 6) score
    from q join post using (term) join df using (term) join dl using (chunk_id), stats group by all)"""
ASKED = r"""
  asked as (select item_id query_id, text || case item_id % 3 when 1 then ' theo luật 2013' when 2 then ' so sánh 2013 2024' else '' end query from benchmark),
  q as (select distinct query_id, unnest(regexp_extract_all(lower(nfc_normalize(query)), '[0-9]{1,4}[/-][0-9]{4}[/-]qh[0-9]+|[0-9]+[a-z]?|\p{L}+')) term from asked)"""


def lexical_sql(k: int) -> str:
    return f"{INDEX}, {ASKED}, {SCORES}, lex as (select *, (row_number() over (partition by query_id order by score desc, chunk_id desc))::bigint rank from scored where score > 0 qualify rank <= {k})"


def dense_sql(k: int) -> str:
    return f"""
  pairs as (select q.vec_id query_id, v.vec_id, round(list_inner_product(q.embedding::double[], v.embedding::double[]), 6) score from embeddings q join benchmark on item_id = q.vec_id cross join embeddings v),
  den as (select query_id, vec_id::varchar chunk_id, (row_number() over (partition by query_id order by score desc, vec_id))::bigint rank, score from pairs qualify rank <= {k})"""


@query("tokens_tf", f"with {INDEX} select chunk_id, term, tf, dl from post join dl using (chunk_id)")
def tokens_tf(spark, sf):
    return postings(spark, sf)


@query("doc_freq", f"with {INDEX} select term, df from df")
def doc_freq(spark, sf):
    return lexical.document_frequencies(postings(spark, sf))


@query("corpus_stats", f"with {INDEX} select n, round(avgdl, 9) avgdl from stats")
def corpus_stats(spark, sf):
    return stats(spark, sf).withColumn("avgdl", F.round("avgdl", 9))


@query("idf_table", f"with {INDEX} select term, df, round(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)), 6) idf from df, stats")
def idf_table(spark, sf):
    n = stats(spark, sf).select("n").scalar()
    return lexical.document_frequencies(postings(spark, sf)).select("term", "df", F.round(lexical.idf(n, F.col("df")), 6).alias("idf"))


@query("bm25_topk", f"with {INDEX}, q as (select 1 query_id, unnest(string_split('{TERMS}', ' ')) term), {SCORES} select chunk_id, score from scored where score > 0 order by score desc, chunk_id desc limit 20")
def bm25_topk(spark, sf):
    asked = spark.createDataFrame([(1, TERMS)], "query_id int, query string")
    found = lexical.scores(*lexical.matched(chunks(spark, sf), asked), asked).where("bm25_score > 0")
    return found.orderBy(F.desc("bm25_score"), F.desc("chunk_id")).limit(20).select("chunk_id", F.col("bm25_score").alias("score"))


@query("bm25_batch_topk", f"with {lexical_sql(10)} select query_id, rank, chunk_id, score from lex")
def bm25_batch_topk(spark, sf):
    return lexical_hits(spark, sf, 10).select("query_id", "rank", "chunk_id", "score")


STORED = INDEX.replace("nfc_normalize(text)", "nfc_normalize(text || chr(10) || source || chr(10) || chr(10) || lang)").replace("from documents)", "from documents where trim(text) <> '')", 1)


@query("stored_lexical_index", f"with {STORED}, {ASKED}, {SCORES} select query_id, chunk_id, score, (row_number() over (partition by query_id order by score desc, chunk_id desc))::bigint rank from scored where score > 0 qualify rank <= 5")
def stored_lexical_index(spark, sf):
    path = folder(spark, "lexical-index")
    tables.save_lexical(chunks(spark, sf).where("trim(text) <> ''"), path)
    lists, facts, _ = tables.load_lexical(spark, path)
    return lexical.search(lists, facts, questions(spark, sf), top_k=5).select("query_id", "chunk_id", F.col("bm25_score").alias("score"), "rank")


@query("stored_dense_index", """with unit as (select vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) e from embeddings),
  pairs as (select q.vec_id query_id, v.vec_id, round(list_inner_product(q.e, v.e), 6) vector_score from unit q join benchmark on item_id = q.vec_id cross join unit v)
  select query_id, vec_id, vector_score, (row_number() over (partition by query_id order by vector_score desc, vec_id))::bigint rank from pairs qualify rank <= 5""")
def stored_dense_index(spark, sf):
    path = folder(spark, "dense-index")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    tables.save_dense(rows, path)
    vectors = tables.load_dense(spark, path)
    asked = vectors.join(questions(spark, sf).select(F.col("query_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.search(vectors, asked, 5).select("query_id", "vec_id", "vector_score", "rank")


@query("encoder_prefixes", "select doc_id, md5('passage: ' || trim(regexp_replace(text, '\\s+', ' ', 'g'))) digest from documents where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def encoder_prefixes(spark, sf):
    return docs(spark, sf).where(F.rlike("text", F.lit(r"\S"))).select("doc_id", F.md5(prefixed(F.col("text"), "passage: ")).alias("digest"))


@query("context_blocks", "select doc_id, md5('[Nguồn ' || (doc_id % 9 + 1) || ']' || chr(10) || 'Cấu trúc: ' || source || ' → ' || lang || chr(10) || 'Nội dung:' || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13))) digest from documents")
def context_blocks(spark, sf):
    none = [F.lit(None).cast("string").alias(c) for c in ("chapter", "section", "article_title", "clause", "point")]
    rows = chunks(spark, sf).select("*", *none)
    return rows.select(F.col("chunk_pos").alias("doc_id"), F.md5(evidence.block(F.col("chunk_pos") % 9 + 1, evidence.path_of(), F.col("text"))).alias("digest"))


FILE = "case when doc_id % 5 = 0 then 'khong-so.docx' when doc_id % 7 = 0 then 'Luat 31-2024-QH15.docx' else concat('luat_', cast(doc_id % 60 as string), case when doc_id % 2 = 0 then '-' else '/' end, cast(2000 + doc_id % 30 as string), '-qh', cast(doc_id % 17 as string), '.docx') end"
NUMBER = "nullif(regexp_replace(regexp_extract(file, '(?i)([0-9]+[-/][0-9]{4}[-/]QH[0-9]+)', 1), '(?i)[-/]([0-9]{4})[-/]QH', '-\\1-QH'), '')"


@query("document_numbers", f"""with f as (select doc_id, {FILE} file from documents), n as (select doc_id, {NUMBER} number from f)
  select doc_id, coalesce(number, '') number, coalesce(case {' '.join(f"when number = '{k}' then '{v}'" for k, v in V.DOCUMENT_TITLES.items())} else number end, '') title from n""")
def document_numbers(spark, sf):
    number = structure.document_number_of(F.expr(FILE))
    return docs(spark, sf).select("doc_id", F.coalesce(number, F.lit("")).alias("number"), F.coalesce(structure.title_of(number), F.lit("")).alias("title"))


@query("vector_norm_check", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) norm, len(embedding)::int dim from embeddings")
def vector_norm_check(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.round(dense.norm(F.col("embedding")), 5).alias("norm"), F.size("embedding").alias("dim"))


@query("vector_violations", """select vec_id, case when vec_id % 7 = 0 then 'null' when vec_id % 11 = 0 or len(embedding) <> 64 then 'dimension' when vec_id % 13 in (0, 1) then 'value' end as rule from embeddings
  where vec_id % 7 = 0 or vec_id % 11 = 0 or vec_id % 13 in (0, 1) or len(embedding) <> 64""")
def vector_violations(spark, sf):
    broken = """case when vec_id % 7 = 0 then null when vec_id % 11 = 0 then slice(embedding, 1, 10) when vec_id % 13 = 0 then transform(embedding, (x, i) -> if(i = 5, float('nan'), x))
      when vec_id % 13 = 1 then transform(embedding, (x, i) -> if(i = 63, float('-infinity'), x)) else embedding end"""
    return dense.violations(spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("embedding", F.expr(broken)), 64)


@query("unit_vectors", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)) / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) total from embeddings")
def unit_vectors(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("u", dense.unit(F.col("embedding")))
    return v.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("cosine_topk", "select v.vec_id, round(list_inner_product(q.embedding::double[], v.embedding::double[]), 6) vector_score from embeddings v, (select embedding from embeddings where vec_id = 0) q order by 2 desc, 1 limit 20")
def cosine_topk(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    return dense.search(v, v.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 20).select("vec_id", "vector_score")


@query("cosine_batch_topk", f"with {dense_sql(10)} select query_id, rank, chunk_id, score from den")
def cosine_batch_topk(spark, sf):
    return dense_hits(spark, sf, 10).select("query_id", "rank", "chunk_id", "score")


FUSED = f"""{lexical_sql(20)}, {dense_sql(20)},
  fused as (select coalesce(l.query_id, d.query_id) query_id, coalesce(l.chunk_id, d.chunk_id) chunk_id, l.score bm25_score, l.rank bm25_rank, d.score vector_score, d.rank vector_rank,
    coalesce(1::double / (60 + l.rank), 0) + coalesce(1::double / (60 + d.rank), 0) rrf from lex l full join den d on l.query_id = d.query_id and l.chunk_id = d.chunk_id)"""


def fused(spark, sf):
    return fusion.fused(lexical_hits(spark, sf, 20), dense_hits(spark, sf, 20))


@query("rrf_fusion", f"with {FUSED} select query_id, chunk_id, coalesce(bm25_score, 0) bm25_score, coalesce(bm25_rank, 0)::bigint bm25_rank, coalesce(vector_score, 0) vector_score, coalesce(vector_rank, 0)::bigint vector_rank, round(rrf, 8) rrf_score from fused")
def rrf_fusion(spark, sf):
    return fused(spark, sf).withColumn("rrf_score", F.round("rrf_score", 8)).na.fill(0)


BOOSTED = f"""{FUSED},
  meta as (select f.*, query, case lang when 'fr' then 2013 when 'en' then 2024 when 'de' then 2025 end as version_year,
    case when query_id % 5 = 0 and lang = 'fr' then 1 else 0 end exact_match_count from fused f join asked using (query_id) left join documents d on d.doc_id::varchar = f.chunk_id),
  intent as (select *, case query_id % 3 when 0 then 'current_default' when 1 then 'explicit' else 'comparison' end version_intent from meta),
  boosted as (select *, round(rrf + case when version_intent = 'explicit' and version_year = 2013 then 0.02::double when version_intent = 'comparison' and version_year in (2013, 2024) then 0.01::double
    when version_intent = 'current_default' and version_year = 2024 then 0.005::double else 0::double end, 8) final_score from intent)"""


def boosted(spark, sf):
    meta = chunks(spark, sf).select("chunk_id", "document_id", "document_title", "article", "year")
    rows = fused(spark, sf).join(questions(spark, sf), "query_id").join(meta, "chunk_id", "left")
    rows = rows.withColumn("want_article", F.when(F.col("query_id") % 5 == 0, F.lit("FR")))
    return fusion.version_boosted(rows.withColumn("exact_match_count", fusion.exact_matches("article")))


KEY = "exact_match_count desc, final_score desc, bm25_score desc nulls last, chunk_id desc"


@query("hybrid_rank", f"with {BOOSTED} select query_id, chunk_id, coalesce(version_year, 0) version_year, version_intent, exact_match_count, final_score, (row_number() over (partition by query_id order by {KEY}))::bigint rank from boosted")
def hybrid_rank(spark, sf):
    w = fusion.Window.partitionBy("query_id").orderBy(*fusion.order())
    return boosted(spark, sf).withColumn("rank", F.row_number().over(w).cast("long")).select("query_id", "chunk_id", "version_year", "version_intent", "exact_match_count", "final_score", "rank").na.fill(0, ["version_year"])


@query("comparison_quota", f"""with {BOOSTED},
  marked as (select *, version_intent = 'comparison' and coalesce(version_year in (2013, 2024), false) and row_number() over (partition by query_id, version_year order by {KEY}) = 1 must from boosted),
  cut as (select * from marked qualify row_number() over (partition by query_id order by must desc, {KEY}) <= 8)
  select query_id, chunk_id, coalesce(version_year, 0) version_year, round(rrf, 8) rrf_score, final_score, (row_number() over (partition by query_id order by {KEY}))::bigint rank from cut""")
def comparison_quota(spark, sf):
    return fusion.final_ranked(boosted(spark, sf), 8).select("query_id", "chunk_id", "version_year", "rrf_score", "final_score", "rank").na.fill(0, ["version_year"])


@query("retriever_ablation", f"""with {lexical_sql(10)}, {dense_sql(10)}
  select 'lexical' as method, query_id, chunk_id, rank, score lexical_score, null::double dense_score from lex union all select 'dense', query_id, chunk_id, rank, null, score from den""")
def retriever_ablation(spark, sf):
    return fusion.ablation(lexical=lexical_hits(spark, sf, 10), dense=dense_hits(spark, sf, 10))


RELEVANT = "relevant as (select distinct q.vec_id query_id, v.vec_id::varchar chunk_id from embeddings q join benchmark on item_id = q.vec_id join embeddings v on v.label = q.label)"


@query("recall_mrr_at_k", f"""with {dense_sql(10)}, {RELEVANT},
  hits as (select query_id, count(*) hits, min(rank) f from den join relevant using (query_id, chunk_id) where rank <= 5 group by query_id),
  every as (select query_id, count(*) n from relevant group by query_id)
  select query_id, round(coalesce(hits, 0)::double / n, 9) recall, coalesce(hits, 0)::double / 5 as precision, round(coalesce(1::double / f, 0), 9) reciprocal_rank from every left join hits using (query_id)""")
def recall_mrr_at_k(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label")
    asked = v.join(questions(spark, sf).select(F.col("query_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "label")
    relevant = asked.join(v, "label").select("query_id", F.col("vec_id").cast("string").alias("chunk_id"))
    out = evaluation.quality(dense_hits(spark, sf, 10), relevant, 5)
    return out.select("query_id", F.round("recall", 9).alias("recall"), "precision", F.round("reciprocal_rank", 9).alias("reciprocal_rank"))


MOST = 400
SPLIT = f"""
  recursive split as (
    select doc_id, 0 piece, null::varchar as out, text rem from documents where text is not null
    union all
    select doc_id, piece + 1, case when length(rem) <= {MOST} then rem else trim(substr(rem, 1, cut), chr(32) || chr(9) || chr(10) || chr(13)) end,
           case when length(rem) <= {MOST} then null else trim(substr(rem, cut + 1), chr(32) || chr(9) || chr(10) || chr(13)) end
    from (select *, case when best <= 0 then {MOST} else best + 1 end cut from (
      select *, case when sentence < {MOST // 2} then {MOST} - strpos(reverse(head), ' ') else sentence end best0,
             case when sentence < {MOST // 2} then case when strpos(head, ' ') > 0 then {MOST} - strpos(reverse(head), ' ') else -1 end else sentence end best from (
        select *, greatest(case when strpos(head, '. ') > 0 then {MOST} - strpos(reverse(head), ' .') - 1 else -1 end, case when strpos(head, '; ') > 0 then {MOST} - strpos(reverse(head), ' ;') - 1 else -1 end) sentence
        from (select *, substr(rem, 1, {MOST}) head from split where rem is not null and (rem <> '' or piece = 0))))))"""


@query("split_long_text", f"with {SPLIT} select doc_id, piece::int piece, length(out)::int size, md5(out) digest from split where piece > 0")
def split_long_text(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.posexplode(structure.split_long(F.col("text"), MOST)).alias("at", "out"))
    return rows.select("doc_id", (F.col("at") + 1).alias("piece"), F.length("out").alias("size"), F.md5("out").alias("digest"))


@query("chunk_ids", "select doc_id, lower(source) || '-' || substr(sha1(source || '|' || lang || '||' || '|' || doc_id || '|' || text), 1, 16) chunk_id from documents")
def chunk_ids(spark, sf):
    return docs(spark, sf).select("doc_id", structure.chunk_id(F.col("source"), F.col("lang"), F.lit(None), F.lit(None), F.col("doc_id"), F.col("text")).alias("chunk_id"))


@query("duplicate_checks", "select text_digest as chunk_id, 'repeated_id' as rule from (select md5(text) text_digest from documents) group by 1 having count(*) > 1")
def duplicate_checks(spark, sf):
    return chunk_violations(docs(spark, sf).select(F.md5("text").alias("chunk_id"), "text"))


def hits(spark, sf, k=10):
    # what follows goes back to these few rows several times: they are made once
    rows = written(lexical_hits(spark, sf, k).select("query_id", "chunk_id", F.col("rank").alias("pos")), "hits")
    return rows.join(questions(spark, sf), "query_id").join(chunks(spark, sf), "chunk_id")


HITS = f"{lexical_sql(10)}, hits as (select query_id, chunk_id, rank pos, query, source, lang, text, doc_id from lex join asked using (query_id) join documents on doc_id::varchar = chunk_id)"


@query("version_isolation", f"""with {HITS} select query_id, pos, chunk_id from (select *, case query_id % 3 when 1 then '2013' when 2 then 'comparison' else 'current' end intent, lang = 'fr' old from hits)
  where intent = 'comparison' or (intent = '2013') = old""")
def version_isolation(spark, sf):
    rows = hits(spark, sf).withColumn("document_id", F.when(F.col("article") == "fr", F.lit("45-2013-QH13")).otherwise(F.col("document_id")))
    return evidence.isolated(rows).select("query_id", "pos", "chunk_id")


@query("side_isolation", f"with {HITS} select query_id, pos, chunk_id, case when lang = 'fr' then '2013' else 'current' end side from hits where lang in ('fr', 'en', 'de')")
def side_isolation(spark, sf):
    return evidence.by_side(hits(spark, sf)).select("query_id", "pos", "chunk_id", "side")


TARGETS = f"{HITS}, targets as (select query_id, source, lang, min(pos)::bigint first_pos from hits group by all having count(*) >= 2)"


@query("article_targets", f"with {TARGETS} select query_id, source key_document_id, lang key_article, first_pos from targets")
def article_targets(spark, sf):
    return evidence.targets(hits(spark, sf))


NEAR = f"""{TARGETS},
  near as (select t.query_id, d.doc_id, d.text, first_pos, min(abs(d.doc_id - h.doc_id)) distance from targets t join documents d using (source, lang) join hits h on h.query_id = t.query_id and h.source = t.source and h.lang = t.lang
    where not exists (select 1 from hits x where x.query_id = t.query_id and x.doc_id = d.doc_id) group by all),
  turns as (select *, (row_number() over (partition by query_id order by first_pos, distance, doc_id))::bigint turn from near)"""


@query("sibling_distance", f"with {NEAR} select query_id, doc_id::varchar chunk_id, distance::bigint distance, turn from turns")
def sibling_distance(spark, sf):
    return evidence.siblings(hits(spark, sf), chunks(spark, sf)).select("query_id", "chunk_id", F.col("distance").cast("long").alias("distance"), "turn")


BUDGET = 5000
WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))"


@query("greedy_expand", f"""with recursive {NEAR},
  priced as (select query_id, doc_id, turn, {WORDS} as cost from turns),
  spent as (select query_id, sum({WORDS}) s from hits group by query_id),
  walk as (select query_id, 0::bigint turn, s, null::bigint took from spent
    union all select w.query_id, p.turn, case when s + cost <= {BUDGET} then s + cost else s end, case when s + cost <= {BUDGET} then p.doc_id end from walk w join priced p on p.query_id = w.query_id and p.turn = w.turn + 1)
  select query_id, took::varchar chunk_id from walk where took is not null""")
def greedy_expand(spark, sf):
    found = hits(spark, sf)
    near = evidence.siblings(found, chunks(spark, sf), counted=False).select("query_id", "turn", "chunk_id", evidence.n_words(F.col("text")).cast("long").alias("cost"))
    return evidence.admitted(found.select("query_id", evidence.n_words(F.col("text")).cast("long").alias("cost")), near, BUDGET)


@query("context_pack", f"""with {HITS}, n as (select query_id, pos, {WORDS} n, text from hits), upto as (select *, sum(n) over (partition by query_id order by pos) s from n)
  select query_id, pos::bigint evidence_pos, least(n, 1500)::bigint tokens, md5(case when n > 1500 then array_to_string(regexp_extract_all(text, '\\s*\\S+')[1:1500], '') else text end) digest from upto where s <= 1500 or pos = 1""")
def context_pack(spark, sf):
    rows = evidence.packed(hits(spark, sf).select("query_id", F.col("pos").alias("evidence_pos"), F.col("text").alias("block")), 1500)
    return rows.select("query_id", "evidence_pos", "tokens", F.md5("block").alias("digest"))


@query("context_pack_characters", f"""with {HITS}, n as (select query_id, pos, length(text) n, text from hits), upto as (select *, sum(n) over (partition by query_id order by pos) s from n)
  select query_id, pos::bigint evidence_pos, least(n, 3000)::bigint tokens, md5(substr(text, 1, 3000)) digest from upto where s <= 3000 or pos = 1""")
def context_pack_characters(spark, sf):
    rows = evidence.packed(hits(spark, sf).select("query_id", F.col("pos").alias("evidence_pos"), F.col("text").alias("block")), 3000, evidence.CHARACTERS)
    return rows.select("query_id", "evidence_pos", "tokens", F.md5("block").alias("digest"))


EXPANDED = f"""{NEAR},
  priced as (select query_id, doc_id, turn, 6 + len(string_split(trim(source), ' ')) + 1 + len(string_split(trim(lang), ' ')) + {WORDS} as cost from turns join documents using (doc_id, text)),
  spent as (select query_id, sum(6 + len(string_split(trim(source), ' ')) + 1 + len(string_split(trim(lang), ' ')) + {WORDS}) s from hits group by query_id),
  walk as (select query_id, 0::bigint turn, s, null::bigint took from spent
    union all select w.query_id, p.turn, case when s + cost <= {BUDGET} then s + cost else s end, case when s + cost <= {BUDGET} then p.doc_id end from walk w join priced p on p.query_id = w.query_id and p.turn = w.turn + 1),
  every as (select query_id, doc_id, pos, false expanded from hits union all select query_id, took, null, true from walk where took is not null)"""


@query("evidence_order", f"""with recursive {EXPANDED},
  placed as (select v.*, first_pos from every v join documents d using (doc_id) left join targets t on t.query_id = v.query_id and t.source = d.source and t.lang = d.lang)
  select query_id, (row_number() over (partition by query_id order by coalesce(first_pos, pos), case when first_pos is not null then doc_id end nulls first, doc_id::varchar))::bigint evidence_pos, doc_id::varchar chunk_id, expanded from placed""")
def evidence_order(spark, sf):
    rows = [F.lit(None).cast("string").alias(c) for c in ("chapter", "section", "article_title", "clause", "point")]
    corpus = chunks(spark, sf).select("*", *rows)
    return evidence.expanded(hits(spark, sf).select("*", *rows), corpus, BUDGET)


@query("ingested_pages", r"""select page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))::int chars from pages""")
def ingested_pages(spark, sf):
    text = search_form(F.regexp_replace("html", "<[^>]*>", " "))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.length(text).alias("chars"))


@query("user_turns", r"""select conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[0-9]+[a-z]?|\p{L}+'), ' ') tokens from conversations where role = 'user'""")
def user_turns(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'")
    return rows.select("conv_id", "turn", F.array_join(lexical.tokens(F.col("text")), " ").alias("tokens"))
