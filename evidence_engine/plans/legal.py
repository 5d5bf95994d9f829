"""Queries in the domain's language: parsing, routing, references, citations and comparison.

Their questions, answers, metadata and laws are made of the tables' rows by expressions that Spark and
DuckDB share; focus_rerank and mapping_rules run over literal rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_engine.functions import intents, speech, text
from evidence_engine.functions import vocabulary as V
from evidence_engine.operators import citations, comparison, lexical, structure
from evidence_engine.plans.registry import query
from evidence_engine.sources.scratch import spread, written


def quoted(x) -> str:
    return "null" if x is None else f"{x}::bigint" if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values(rows, names: str) -> str:
    """A literal relation for DuckDB."""
    return "(select * from (values " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") v({names}))"


QUESTIONS = [
    (1, "Điều 12 khoản 3 điểm Đ của luật 31/2024/QH15 quy định gì?"), (2, "So sánh quyền theo Luật Đất đai 2013 và 2024"), (3, "Luật Đất đai 2013 quy định thu hồi đất thế nào?"),
    (4, "KHOẢN 5 ĐIỀU 7A nói gì"), (5, "thay đổi mục đích sử dụng đất"), (6, "Trước đây và hiện nay khác gì?"), (7, "nghĩa vụ của người sử dụng đất"), (8, "Luật Đất đai 1993"),
    (9, "2013, 2024"), (10, "45 - 2013 - qh13 điều 4"), (11, "điều kiện năm 20134"), (12, "Luật đất đai 2025 điểm b"), (13, "đối chiếu 2013 với 2024"), (14, "Khoản hai điều ba"),
]
DOCUMENTS = list(V.DOCUMENT_TITLES.items())
B = r"(^|[^\p{L}\p{N}_])"
E = r"($|[^\p{L}\p{N}_])"
#: Each text of the benchmark asks with one of these questions before it.
Q = f"(select item_id query_id, query || ' ' || substr(replace(text, chr(10), ' '), 1, 40) query from benchmark join {values(QUESTIONS, 'nth, query')} q on nth = item_id % {len(QUESTIONS)} + 1)"
PLAIN = "trim(regexp_replace(lower(query), '\\s+', ' ', 'g'))"


def questions(spark, sf):
    known = spark.createDataFrame(QUESTIONS, "nth long, query string")
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").join(known, F.expr(f"nth = item_id % {len(QUESTIONS)} + 1"))
    return rows.select(F.col("item_id").alias("query_id"), F.concat("query", F.lit(" "), F.expr("substr(replace(text, chr(10), ' '), 1, 40)")).alias("query"))


def documents(spark):
    return spark.createDataFrame(DOCUMENTS, "document_id string, document_title string")


REFS = f"""
  asked as (select query_id, {PLAIN} q from {Q}),
  refs as (select query_id, q,
    case when regexp_matches(q, '{B}[0-9]{{1,4}}\\s*[/-]\\s*[0-9]{{4}}\\s*[/-]\\s*qh\\s*[0-9]+{E}') then regexp_extract(q, '{B}([0-9]{{1,4}})\\s*[/-]\\s*([0-9]{{4}})\\s*[/-]\\s*qh\\s*([0-9]+){E}', 2) || '-' ||
      regexp_extract(q, '{B}([0-9]{{1,4}})\\s*[/-]\\s*([0-9]{{4}})\\s*[/-]\\s*qh\\s*([0-9]+){E}', 3) || '-QH' || regexp_extract(q, '{B}([0-9]{{1,4}})\\s*[/-]\\s*([0-9]{{4}})\\s*[/-]\\s*qh\\s*([0-9]+){E}', 4) end document_id,
    'Điều ' || nullif(regexp_extract(q, '{B}điều\\s+([0-9]+[a-z]?){E}', 2), '') article, 'Khoản ' || nullif(regexp_extract(q, '{B}khoản\\s+([0-9]+){E}', 2), '') clause,
    'Điểm ' || nullif(regexp_extract(q, '{B}điểm\\s+([a-zđ]){E}', 2), '') point from asked)"""
SHOWN = "coalesce(document_id, '') document_id, coalesce(article, '') article, coalesce(clause, '') clause, coalesce(point, '') point"


@query("legal_refs", f"with {REFS} select query_id, {SHOWN} from refs")
def legal_refs(spark, sf):
    return questions(spark, sf).select("query_id", *[F.coalesce(v, F.lit("")).alias(k) for k, v in text.references(F.col("query")).items()])


INFERRED = f"""{REFS},
  meant as (select query_id, min(d.document_id) meant from refs r, {values(DOCUMENTS, 'document_id, document_title')} d
    where r.document_id is null and contains(q, 'luật đất đai') and regexp_matches(q, '{B}(19|20)[0-9]{{2}}{E}') and contains(d.document_id, regexp_extract(q, '{B}((19|20)[0-9]{{2}}){E}', 2))
      and contains(lower(document_title), 'luật đất đai') and not starts_with(lower(document_title), 'luật số 43') group by query_id having count(*) = 1),
  wanted as (select r.query_id, coalesce(document_id, meant) document_id, article, clause, point from refs r left join meant using (query_id))"""


@query("year_inference", f"with {INFERRED} select query_id, coalesce(document_id, '') document_id from wanted")
def year_inference(spark, sf):
    return lexical.with_references(questions(spark, sf), documents(spark)).select("query_id", F.coalesce("want_document_id", F.lit("")).alias("document_id"))


CHUNKS = [
    ("a1", "31-2024-QH15", "Điều 12", "Khoản 3", "Điểm đ"), ("a2", "31-2024-QH15", "Điều 12", "Khoản 4", None), ("a3", "45-2013-QH13", "Điều 12", "Khoản 3", "Điểm a"), ("a4", "45-2013-QH13", "Điều 4", None, None),
    ("a5", "254-2025-QH15", "Điều 7a", "Khoản 5", "Điểm b"), ("a6", None, None, None, None),
]
C = values(CHUNKS, "chunk_id, d, a, c, p")


@query("metadata_boost", f"""with {INFERRED}, m as (select w.query_id, chunk_id, case when lower(d) = lower(document_id) then 4.0::double else 0 end + case when lower(a) = lower(article) then 10.0::double else 0 end
  + case when lower(c) = lower(clause) then 6.0::double else 0 end + case when lower(p) = lower(point) then 3.0::double else 0 end metadata_boost from wanted w, {C} k) select * from m where metadata_boost > 0""")
def metadata_boost(spark, sf):
    meta = spark.createDataFrame(CHUNKS, "chunk_id string, document_id string, article string, clause string, point string")
    return lexical.boosted(lexical.with_references(questions(spark, sf), documents(spark)), meta).select("query_id", "chunk_id", "metadata_boost")


def any_sql(column: str, phrases) -> str:
    return "(" + " or ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


@query("version_intents", f"""with asked as (select query_id, {PLAIN} q, regexp_matches({PLAIN}, '{B}2013{E}') y13, regexp_matches({PLAIN}, '{B}2024{E}') y24 from {Q})
  select query_id, case when {any_sql('q', V.FUSION_COMPARISON)} or (y13 and y24) then 'comparison' when y13 or y24 then 'explicit' else 'current_default' end fusion_intent,
    case when {any_sql('q', V.PROMPT_COMPARISON)} then 'comparison' when contains(q, '2013') then '2013' else 'current' end prompt_intent,
    case when {any_sql('q', V.ROUTE_COMPARISON)} or (y13 and y24) or ({any_sql('q', V.ROUTE_PAST)} and {any_sql('q', V.ROUTE_PRESENT)}) then 'comparison' else 'qa' end route_intent from asked""")
def version_intents(spark, sf):
    q = F.col("query")
    return questions(spark, sf).select("query_id", intents.fusion_intent(q).alias("fusion_intent"), intents.prompt_intent(q).alias("prompt_intent"), intents.route_intent(q).alias("route_intent"))


def topic_sql() -> str:
    out = "query"
    for p in sorted(V.TOPIC_PHRASES, key=lambda p: -len(p)):
        out = f"regexp_replace({out}, '(?i){p}', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)\\b(?:45[/-]2013[/-]QH13|31[/-]2024[/-]QH15)\\b', ' ', 'g')"
    out = f"trim(regexp_replace({out}, '\\s+', ' ', 'g'), ' .,:;?-–—')"
    return f"coalesce(nullif({out}, ''), trim(query))"


@query("comparison_topics", f"select query_id, {topic_sql()} topic from {Q}")
def comparison_topics(spark, sf):
    return questions(spark, sf).select("query_id", intents.topic(F.col("query")).alias("topic"))


PAGES = ["- 12 -", "–3–", "Trang 4", "PAGE 5 / 10", "2024", "Điều 3. Trang", "trang 12345", " page 1/2 ", "-12", ""]
#: Every seventh line of a document gives way to one of these.
LISTED = "[" + ", ".join(map(quoted, PAGES)) + "]"


@query("page_number_pred", f"""with x as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1)::bigint line_no from documents)
  select doc_id, line_no, regexp_full_match(case when line_no % 7 = 0 then {LISTED}[(doc_id + line_no) % {len(PAGES)} + 1] else line end, '(?i)\\s*(?:[-–—]\\s*[0-9]{{1,4}}\\s*[-–—]|(?:trang|page)\\s+[0-9]{{1,4}}(?:\\s*/\\s*[0-9]{{1,4}})?)\\s*') is_page from x""")
def page_number_pred(spark, sf):
    rows = spread(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line_no", F.col("at").cast("long") + 1)
    line = F.when(F.col("line_no") % 7 == 0, F.get(F.array(*map(F.lit, PAGES)), ((F.col("doc_id") + F.col("line_no")) % len(PAGES)).cast("int"))).otherwise(F.col("line"))
    return rows.select("doc_id", "line_no", text.is_page_number(line).alias("is_page"))


META = [
    (1, "Luật A", "1-2024-QH15", "Chương I - Chung", "Mục 1 - X", "Điều 1", "Phạm vi", "Khoản 1", "Điểm a"), (2, None, "45-2013-QH13", None, None, "Điều 2", None, None, None), (3, " ", "", None, None, None, "Tên", None, None),
    (4, None, None, None, None, None, None, None, None), (5, "Luật năm 1999 và 2003", "x", None, None, "Điều  5", " ", "Khoản 2", None),
]
META_NAMES = "nth, document_title, document_id, chapter, section, article, article_title, clause, point"
#: Each document has the metadata of one of these, with its own source and language in place of some.
META_OF = f"(select doc_id, case when doc_id % 3 = 0 then 'Luật  ' || source else document_title end document_title, case when doc_id % 4 = 1 then source || '-20' || (doc_id % 90 + 10) else document_id end document_id, chapter, section, article, case when doc_id % 7 = 2 then lang else article_title end article_title, clause, point from documents join {values(META, META_NAMES)} m on nth = doc_id % 5 + 1)"
FILL = lambda c: f"nullif(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')), '')"


@query("source_format", f"""select doc_id, coalesce(nullif(concat_ws(' → ', coalesce({FILL('document_title')}, {FILL('document_id')}), {FILL('chapter')}, {FILL('section')}, nullif(concat_ws('. ', {FILL('article')}, {FILL('article_title')}), ''), {FILL('clause')}, {FILL('point')}), ''), 'Không rõ nguồn') source,
  coalesce(case when coalesce({FILL('document_title')}, {FILL('document_id')}) is not null then concat_ws(' → ', coalesce({FILL('document_title')}, {FILL('document_id')}), {FILL('article')}, {FILL('clause')}, {FILL('point')}) end, '') cite,
  coalesce(try_cast(regexp_extract(concat_ws(' ', coalesce(document_id, ''), coalesce(document_title, '')), '\\b(20[0-9]{{2}})\\b', 1) as int), 0) version_year from {META_OF}""")
def source_format(spark, sf):
    known = spark.createDataFrame(META, ", ".join(f"{n} {'long' if n == 'nth' else 'string'}" for n in META_NAMES.split(", ")))
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang").join(known, F.expr("nth = doc_id % 5 + 1"))
    own = {
        "document_title": "case when doc_id % 3 = 0 then concat('Luật  ', source) else document_title end", "document_id": "case when doc_id % 4 = 1 then concat(source, '-20', cast(doc_id % 90 + 10 as string)) else document_id end",
        "article_title": "case when doc_id % 7 = 2 then lang else article_title end",
    }
    rows = rows.withColumns({k: F.expr(v) for k, v in own.items()})
    c = {n: F.col(n) for n in META_NAMES.split(", ")}
    path = text.source_path(*[c[n] for n in ("document_title", "document_id", "chapter", "section", "article", "article_title", "clause", "point")])
    cite = text.citation_text(*[c[n] for n in ("document_title", "document_id", "article", "clause", "point")])
    return rows.select("doc_id", path.alias("source"), F.coalesce(cite, F.lit("")).alias("cite"), F.coalesce(text.version_year(F.lit(None), c["document_id"], c["document_title"]), F.lit(0)).alias("version_year"))


LAW = """Luật Đất đai
Căn cứ Hiến pháp
CHƯƠNG I
QUY ĐỊNH CHUNG
Mục 1
PHẠM VI
Điều 1. Phạm vi
Mở đầu của điều.
1. Khoản một gồm:
a) điểm a của khoản một;
tiếp theo điểm a
đ) điểm đ.
dẫn “Trích luật khác
1. không phải khoản
hết trích”
2. Khoản hai không có điểm.
Điều 2. Không có khoản
Nội dung điều hai.
a) điểm mồ côi
MỤC 2. TIÊU ĐỀ CÙNG DÒNG
Điều 3. Cuối
1. Một khoản. Câu hai; câu ba.
Chương 2
Điều 4. Trong chương hai
Nội dung.
Luật này được Quốc hội thông qua
Chủ tịch""".split("\n")
OTHER = ["Mục 3", "Điều 1. A", "1. x", "1. y", "Điều 1. B", "text"]


def law_lines(spark):
    rows = [("31-2024-QH15", k, t) for k, t in enumerate(LAW, 1)] + [("45-2013-QH13", k, t) for k, t in enumerate(OTHER, 1)]
    return spark.createDataFrame(rows, "document_id string, line_no long, text string")


#: Lines of documents as lines of laws; the same expression in Spark and in DuckDB.
AS_LAW = """case (doc_id * 7 + line_no * 13) % 29
  when 0 then concat('Chương ', cast(line_no % 20 + 1 as string)) when 1 then concat('Mục ', cast(line_no % 9 + 1 as string), '. ', line) when 2 then 'CHƯƠNG IV.' when 3 then 'Mục XIV.'
  when 4 then concat('Điều ', cast(line_no as string), '. ', line) when 5 then concat('ĐIỀU ', cast(line_no % 40 as string), 'a. ', line) when 6 then concat('Điều ', cast(line_no % 50 as string), ' . ', line)
  when 7 then concat(cast(line_no % 9 + 1 as string), '. ', line) when 8 then concat(cast(line_no % 9 + 2 as string), '. ', line) when 9 then concat(cast(line_no % 9 + 3 as string), '. ', line) when 10 then concat('1. ', line)
  when 13 then concat(chr(cast(97 + line_no % 26 as int)), ') ', line) when 14 then concat('B ) ', line) when 15 then concat('Đ) ', line) when 16 then concat('c)', line) when 18 then concat('dẫn “', line)
  when 19 then concat(line, '”') when 21 then case when line_no % 7 = 0 then 'Luật này được Quốc hội thông qua' else line end else line end"""


def laws(spark, sf):
    """document_id, line_no and text of every document, its lines made into a law's."""
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "raw"))
    rows = rows.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("line")).where("line <> ''")
    return rows.select(F.col("doc_id").cast("string").alias("document_id"), "line_no", F.expr(AS_LAW).alias("text"))


ROMANS = "map {'I': 1, 'V': 5, 'X': 10, 'L': 50, 'C': 100, 'D': 500, 'M': 1000}"
#: One line after another: what the lines before it have opened is the whole state.
FACTS = f"""
  raw as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line0, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1)::bigint line_no from documents),
  law as (select doc_id, row_number() over (partition by doc_id order by line_no) n, {AS_LAW} as text from (select doc_id, line_no, regexp_replace(line0, '^\\s+|\\s+$', '', 'g') line from raw) where line <> ''),
  known as (select *, regexp_extract(text, '(?i)^Chương\\s+([IVXLCDM]+|\\d+)\\.?$', 1) ch, regexp_extract(text, '(?i)^Mục\\s+([IVXLCDM]+|\\d+)\\s*[.．]?\\s*(.*)$', 1) sec, trim(regexp_extract(text, '(?i)^Mục\\s+([IVXLCDM]+|\\d+)\\s*[.．]?\\s*(.*)$', 2)) sec_title,
    regexp_extract(text, '(?i)^Điều\\s+(\\d+[A-Za-z]?)\\s*[.．]\\s*(.*)$', 1) art, trim(regexp_extract(text, '(?i)^Điều\\s+(\\d+[A-Za-z]?)\\s*[.．]\\s*(.*)$', 2)) art_title, regexp_extract(text, '^(\\d+)\\s*[.．]\\s+.+$', 1) cl,
    lower(regexp_extract(text, '^([a-zA-ZđĐ])\\s*\\)\\s*.+$', 1)) pt, regexp_matches(text, '(?i)^(?:Luật|Nghị quyết) này được Quốc hội') closing,
    len(regexp_extract_all(text, '“')) opens, len(regexp_extract_all(text, '”')) closes from law),
  heads as (select *, lead(text) over w as following, coalesce(lead(ch <> '' or sec <> '' or art <> '') over w, true) next_heads from known window w as (partition by doc_id order by n)),
  walk as (
    select doc_id, 0::bigint n, ''::varchar kind, null::bigint chapter, null::bigint section, null::bigint article, null::bigint clause, null::bigint point, false quoting, false closed, false implicit, false skip from heads group by doc_id
    union all
    select doc_id, n, kind, case when kind = 'chapter' then n else chapter0 end, case when kind = 'chapter' then null when kind = 'section' then n else section0 end,
      case when kind in ('chapter', 'section', 'postamble') then null when kind = 'article' then n else article0 end, case when kind in ('chapter', 'section', 'article', 'postamble') then null when kind = 'clause' then n else clause0 end,
      case when kind in ('chapter', 'section', 'article', 'clause', 'postamble') then null when kind = 'point' then n else point0 end,
      case when kind in ('text', 'preamble') then case when quoting0 then closes <= opens else opens > closes end else quoting0 end, closed0 or kind = 'postamble',
      case when kind = 'chapter' then false when kind = 'section' then implicit0 or chapter0 is null else implicit0 end,
      (kind = 'chapter' or (kind = 'section' and sec_title = '')) and following is not null and not next_heads
    from (select h.*, w.chapter chapter0, w.section section0, w.article article0, w.clause clause0, w.point point0, w.quoting quoting0, w.closed closed0, w.implicit implicit0,
        case when w.skip then 'title' when w.closed or (w.article is not null and not w.quoting and h.closing) then 'postamble' when w.quoting then case when w.article is null then 'preamble' else 'text' end
          when ch <> '' then 'chapter' when sec <> '' then 'section' when art <> '' then 'article' when w.article is not null and cl <> '' then 'clause' when w.article is not null and pt <> '' then 'point'
          when w.article is null then 'preamble' else 'text' end kind from walk w join heads h on h.doc_id = w.doc_id and h.n = w.n + 1)),
  numbered as (select doc_id, n, list_transform(string_split(upper(case when ch <> '' then ch else sec end), ''), lambda c: {ROMANS}[c]) v from heads where not regexp_matches(case when ch <> '' then ch else sec end, '^\\d*$')),
  roman as (select doc_id, n, list_sum(list_transform(range(1, len(v) + 1), lambda i: case when i < len(v) and v[i] < list_max(v[i + 1:]) then -v[i] else v[i] end))::bigint::varchar value from numbered),
  facts as (select doc_id::varchar document_id, n::bigint line_no, kind, case kind when 'chapter' then coalesce(r.value, ch::bigint::varchar) when 'section' then coalesce(r.value, sec::bigint::varchar) when 'article' then art when 'clause' then cl when 'point' then pt end number,
      case kind when 'chapter' then case when skip then following else '' end when 'section' then case when skip then following else sec_title end when 'article' then art_title end title,
      kind = 'section' and implicit as implicit, chapter, section, article, clause, point, text from walk w join heads h using (doc_id, n) left join roman r using (doc_id, n))"""


@query("structure_parse", f"with recursive {FACTS} select * from facts")
def structure_parse(spark, sf):
    return structure.parse(laws(spark, sf))


@query("structure_counts", f"""with recursive {FACTS} select document_id, count(*) filter (kind = 'chapter') chapters, count(*) filter (kind = 'section') sections, count(*) filter (kind = 'article') articles,
  count(*) filter (kind = 'clause') clauses, count(*) filter (kind = 'point') points from facts group by document_id""")
def structure_counts(spark, sf):
    return structure.counts(structure.parse(laws(spark, sf)))


MOST = 400
TO_ROMAN = "[" + ", ".join(f"'{structure.roman(n)}'" for n in range(1, 21)) + "]"
STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
CHUNKED = f"""{FACTS},
  inner_lines as (select *, min(case when kind = 'clause' then line_no end) over (partition by document_id, article) first_clause from facts where article is not null),
  bare as (select document_id, article, null::bigint clause, null::bigint point, '' lead, string_agg(text, chr(10) order by line_no) content, {MOST} most from inner_lines where first_clause is null group by document_id, article),
  intros as (select document_id, article, string_agg(text, chr(10) order by line_no) intro from inner_lines where first_clause is not null and clause is null and point is null and kind = 'text' group by document_id, article),
  own as (select document_id, article, clause, first_clause, string_agg(text, chr(10) order by line_no) filter (where point is null) own, count(point) n_points from inner_lines where clause is not null group by all),
  whole_clauses as (select o.document_id, o.article, clause, n_points, case when clause = first_clause and intro is not null then intro || chr(10) || own else own end own from own o left join intros i on i.document_id = o.document_id and i.article = o.article),
  heads_of as (select document_id, article, clause, null::bigint point, '' lead, case when n_points > 0 then {STRIP.format('own')} else own end content, {MOST} most from whole_clauses),
  own_points as (select document_id, article, clause, point, string_agg(text, chr(10) order by line_no) content from inner_lines where clause is not null and point is not null group by all),
  points as (select p.document_id, p.article, p.clause, point, {STRIP.format('own')} lead, content, case when length(content) > {MOST} then {MOST} - least(length({STRIP.format('own')}), {MOST // 3}) else {MOST} end most
    from own_points p join whole_clauses c on c.document_id = p.document_id and c.article = p.article and c.clause = p.clause),
  parts as (select * from bare union all select * from heads_of union all select * from points),
  split as (
    select document_id, article, clause, point, lead, most, 0 piece, null::varchar as out_text, content rem from parts
    union all
    select document_id, article, clause, point, lead, most, piece + 1, case when length(rem) <= most then rem else {STRIP.format('substr(rem, 1, cut)')} end, case when length(rem) <= most then null else {STRIP.format('substr(rem, cut + 1)')} end
    from (select *, case when best <= 0 then most else best + 1 end cut from (
      select *, case when sentence < most // 2 then case when strpos(head, ' ') > 0 then most - strpos(reverse(head), ' ') else -1 end else sentence end best from (
        select *, greatest(case when strpos(head, '. ') > 0 then most - strpos(reverse(head), ' .') - 1 else -1 end, case when strpos(head, '; ') > 0 then most - strpos(reverse(head), ' ;') - 1 else -1 end) sentence
        from (select *, substr(rem, 1, most) head from split where rem is not null and (rem <> '' or piece = 0)))))),
  pieces as (select *, (row_number() over (partition by document_id, article order by clause nulls first, point nulls first, piece) - 1)::int as sequence, case when lead = '' then out_text else lead || chr(10) || out_text end content from split where piece > 0),
  of_kind as (select document_id, line_no, number, title, text from facts where kind in ('chapter', 'section', 'article', 'clause', 'point')),
  around as (select p.document_id, p.article, p.sequence, p.content, a.number article_number, a.title article_title, a.text heading, cl.number clause_number, pt.number point_number,
      concat_ws(' - ', 'Chương ' || {TO_ROMAN}[ch.number::int], nullif(ch.title, '')) chapter, ch.number chapter_number, concat_ws(' - ', 'Mục ' || sc.number, nullif(sc.title, '')) section, sc.number section_number
    from pieces p join facts a on a.document_id = p.document_id and a.line_no = p.article left join of_kind ch on ch.document_id = p.document_id and ch.line_no = a.chapter left join of_kind sc on sc.document_id = p.document_id and sc.line_no = a.section
      left join of_kind cl on cl.document_id = p.document_id and cl.line_no = p.clause left join of_kind pt on pt.document_id = p.document_id and pt.line_no = p.point),
  made as (select lower(document_id) || '-' || substr(sha1(concat_ws('|', document_id, coalesce(article_number, ''), coalesce(clause_number, ''), coalesce(point_number, ''), sequence::varchar, content)), 1, 16) chunk_id,
      concat_ws(chr(10), document_id, case when chapter_number is not null then chapter end, case when section_number is not null then section end, case when not starts_with(content, heading) then heading end, content) as text, content, document_id, document_id document_title,
      case when chapter_number is not null then chapter else '' end chapter, case when section_number is not null then section else '' end section, 'Điều ' || article_number article, article_title, 'Khoản ' || clause_number clause, 'Điểm ' || point_number point,
      null::varchar source_file, article article_line, sequence, row_number() over (partition by document_id order by article, sequence) - 1 chunk_pos from around)"""


@query("adaptive_chunks", f"with recursive {CHUNKED} select * from made")
def adaptive_chunks(spark, sf):
    return structure.chunks(written(structure.parse(laws(spark, sf)), "facts"), MOST).na.fill("", ["chapter", "section"])


@query("structure_report", f"""with recursive {CHUNKED},
  repeats as (select document_id, article, number from facts where kind = 'clause' group by all having count(*) > 1),
  lost as (select f.document_id, f.article, count(*) n from facts f join (select document_id, article_line, string_agg(text, chr(10)) all_text from made group by all) w on w.document_id = f.document_id and w.article_line = f.article where not contains(all_text, f.text) group by all),
  found as (select document_id, 'section_without_chapter: ' || line_no w from facts where kind = 'section' and implicit union all select document_id, 'point_without_clause: ' || line_no from facts where kind = 'point' and clause is null
    union all select document_id, 'duplicate_article: Điều ' || number from facts where kind = 'article' group by document_id, number having count(*) > 1 union all select document_id, 'duplicate_clause: ' || article || '/' || number from repeats
    union all select document_id, 'article_without_chunk: Điều ' || number from facts f where kind = 'article' and not exists (select 1 from made m where m.document_id = f.document_id and m.article_line = f.line_no)
    union all select document_id, 'duplicate_chunk_id: ' || chunk_id from made group by document_id, chunk_id having count(*) > 1 union all select document_id, 'lines_not_in_chunks: ' || article || ':' || n from lost),
  warned as (select document_id, string_agg(w, ' | ' order by w) warnings from found group by document_id), counted as (select document_id, count(*) chunks from made group by document_id)
  select document_id, count(*) filter (kind = 'chapter') chapters, count(*) filter (kind = 'section') sections, count(*) filter (kind = 'article') articles, count(*) filter (kind = 'clause') clauses, count(*) filter (kind = 'point') points,
    coalesce(any_value(chunks), 0) chunks, coalesce(any_value(warnings), '') warnings from facts left join counted using (document_id) left join warned using (document_id) group by document_id""")
def structure_report(spark, sf):
    facts = written(structure.parse(laws(spark, sf)), "facts")
    return structure.report(facts, written(structure.chunks(facts, MOST), "chunks")).withColumn("warnings", F.array_join("warnings", " | "))


#: Answers and their evidence, made of the benchmark's texts; the same expressions in Spark and in DuckDB.
PHRASE = "trim(substr(replace(replace(replace(text, chr(10), ' '), '[', '('), ']', ')'), 1, 60))"
ANSWER = f"""case when item_id % 13 = 12 then ' ' else concat(case when item_id % 7 = 6 then concat('[Nguồn 1]', chr(10)) else '' end, 'Mở đầu:', chr(10), {PHRASE}, ' [Nguồn ', cast(item_id % 3 + 1 as string), '] [Nguồn 1].', chr(10),
  'Ý hai', chr(10), '[Nguồn 2]', chr(10), chr(10), 'Ý ba [nguồn 1, Nguồn 3]', case when item_id % 5 = 4 then concat(chr(10), 'thiếu nhãn') else '' end, case when item_id % 11 = 10 then concat(chr(10), 'sai nhãn [Nguồn 9]') else '' end) end"""
PROOF = (
    "concat('c', cast(item_id as string), '_', cast(case when item_id % 4 = 0 and k = 3 then 1 else k end as string)) as chunk_id", "concat('Luật ', cast(item_id % 4 as string)) as document_title",
    "concat('Điều ', cast(k % 2 + item_id % 2 as string)) as article", "case when k <> 2 then 'Khoản 1' end as clause",
)
FIT = "answer_id % 13 <> 12 and answer_id % 7 <> 6 and answer_id % 5 <> 4 and answer_id % 11 <> 10"


def made_answers(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("answer_id"), F.expr(ANSWER).alias("answer"))


def made_evidence(spark, sf):
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.explode(F.expr("array(1L, 2L, 3L)")).alias("k"))
    none = F.lit(None).cast("string")
    return rows.selectExpr("item_id as answer_id", "k as evidence_pos", *PROOF).withColumns({"document_id": none, "point": none})


MARK = "(?i)\\[Nguồn\\s+([0-9]+)\\]"
TWO = "'(?i)\\[(Nguồn\\s+[0-9]+)\\s*,\\s*(Nguồn\\s+[0-9]+)', '[\\1] [\\2', 'g'"
CLAIMS = f"""
  a as (select item_id answer_id, {ANSWER} answer from benchmark),
  e as (select item_id answer_id, k evidence_pos, {", ".join(PROOF)} from benchmark, (select unnest([1::bigint, 2, 3]) k)),
  l0 as (select answer_id, unnest(string_split(x, chr(10))) raw, generate_subscripts(string_split(x, chr(10)), 1) - 1 line_no from (select answer_id, trim(regexp_replace(regexp_replace(answer, {TWO}), {TWO}), ' ' || chr(10)) x from a)),
  l1 as (select answer_id, line_no, trim(raw) line, regexp_full_match(trim(raw), '(?i)(\\[Nguồn\\s+[0-9]+\\]\\s*)+') tags from l0),
  l2 as (select *, case when tags then last_value(case when not tags and line <> '' then line_no end ignore nulls) over (partition by answer_id order by line_no rows between unbounded preceding and current row) else line_no end owner from l1),
  l3 as (select answer_id, owner, min(line_no)::bigint line_no, string_agg(line, ' ' order by line_no) line from l2 group by answer_id, owner),
  claims as (select answer_id, line_no, regexp_replace(regexp_replace(line, '{MARK}', '', 'g'), '\\s+$', '') claim, list_transform(regexp_extract_all(line, '{MARK}', 1), lambda t: t::bigint) tags, ends_with(line, ':') heading, line <> '' filled from l3 where owner is not null),
  known as (select *, concat_ws(' → ', document_title, article, clause) cite from e qualify row_number() over (partition by answer_id, chunk_id order by evidence_pos) = 1),
  marks as (select t.answer_id, line_no, claim, spot, chunk_id from (select answer_id, line_no, claim, unnest(tags) pos, generate_subscripts(tags, 1) spot from claims where filled) t join e on e.answer_id = t.answer_id and e.evidence_pos = t.pos),
  sources as (select answer_id, cite, row_number() over (partition by answer_id order by min(evidence_pos)) number, list(chunk_id) ids from known where (answer_id, chunk_id) in (select answer_id, chunk_id from marks) group by answer_id, cite),
  cited as (select answer_id, line_no, claim, chunk_id, number, min(spot) spot from marks join (select answer_id, number, unnest(ids) chunk_id from sources) using (answer_id, chunk_id) group by all),
  tagged as (select c.answer_id, c.line_no, c.claim, chunk_ids, numbers from (select answer_id, line_no, claim, string_agg(chunk_id, ',' order by spot) chunk_ids from cited group by all) c
    join (select answer_id, line_no, string_agg(number, ',' order by spot) numbers from (select answer_id, line_no, number, min(spot) spot from cited group by all) group by all) n using (answer_id, line_no))"""


@query("tagged_claims", f"with {CLAIMS} select answer_id, line_no, claim, chunk_ids, numbers as cited from tagged where {FIT}")
def tagged_claims(spark, sf):
    good = made_answers(spark, sf).where(FIT)
    return citations.tagged(good, made_evidence(spark, sf)).withColumns({"chunk_ids": F.array_join("chunk_ids", ","), "cited": F.array_join("cited", ",")})


@query("citation_violations", f"""with {CLAIMS} select answer_id, -1::bigint line_no, 'empty_answer' as rule from a where trim(answer) = '' union all select answer_id, line_no, 'tags_without_claim' from l3 where owner is null and line <> ''
  union all select answer_id, line_no, 'claim_without_tag' from claims where filled and len(tags) = 0 and not heading union all select answer_id, line_no, 'tag_not_in_evidence' from claims where len(list_filter(tags, lambda t: t < 1 or t > 3)) > 0""")
def citation_violations(spark, sf):
    return citations.violations(made_answers(spark, sf), made_evidence(spark, sf)).na.fill(-1, ["line_no"])


@query("rendered_answers", f"""with {CLAIMS},
  shown as (select answer_id, string_agg(concat_ws(' ', claim, numbers), chr(10) order by line_no) body from (select c.answer_id, c.line_no, c.claim, '[' || replace(numbers, ',', '][') || ']' numbers from claims c left join tagged t using (answer_id, line_no)) group by answer_id),
  listed as (select answer_id, string_agg('[' || number || '] ' || cite, chr(10) order by number) cites from sources group by answer_id)
  select answer_id, trim(body) || coalesce(chr(10) || chr(10) || '{V.BIBLIOGRAPHY}' || chr(10) || cites, '') answer from shown left join listed using (answer_id) where {FIT}""")
def rendered_answers(spark, sf):
    return citations.rendered(made_answers(spark, sf).where(FIT), made_evidence(spark, sf))


@query("manual_citations", f"""with {CLAIMS}, n as (select answer_id, cite, row_number() over (partition by answer_id order by min(evidence_pos)) number, list(chunk_id) ids from known where chunk_id like '%\\_1' escape '\\' or chunk_id like '%\\_2' escape '\\' group by answer_id, cite),
  t as (select item_id answer_id, {PHRASE} t from benchmark where length({PHRASE}) > 40),
  m as (select answer_id, t, (select number from n where n.answer_id = t.answer_id and list_contains(ids, 'c' || t.answer_id || '_1')) n1, (select number from n where n.answer_id = t.answer_id and list_contains(ids, 'c' || t.answer_id || '_2')) n2 from t),
  first as (select *, rtrim(substr(t, 1, 12)) || ' [' || n2 || ']' || case when n1 <> n2 then '[' || n1 || ']' else '' end || substr(t, 13) x, substr(t, 21, 12) claim from m),
  marked as (select *, case when n1 = n2 then t when strpos(x, claim) = 0 then null else substr(x, 1, strpos(x, claim) - 1) || rtrim(claim) || ' [' || n1 || ']' || substr(x, strpos(x, claim) + 12) end y from first),
  cites as (select answer_id, string_agg('[' || number || '] ' || cite, chr(10) order by number) cites from n group by answer_id)
  select answer_id, coalesce(y || chr(10) || chr(10) || '{V.BIBLIOGRAPHY}' || chr(10) || cites, '') answer, case when y is null then 'claim_not_in_answer' else '' end as rule from marked join cites using (answer_id)""")
def manual_citations(spark, sf):
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("answer_id"), F.expr(PHRASE).alias("answer")).where("length(answer) > 40")
    ids = [F.concat(F.lit("c"), F.col("answer_id").cast("string"), F.lit(f"_{k}")) for k in (1, 2)]
    steps = F.array(F.struct(F.lit(1).alias("nth"), F.substring("answer", 1, 12).alias("claim"), F.array(ids[1], ids[0]).alias("chunk_ids")), F.struct(F.lit(2).alias("nth"), F.substring("answer", 21, 12).alias("claim"), F.array(ids[0]).alias("chunk_ids")))
    supports = rows.select("answer_id", F.inline(steps))
    return citations.cited(rows, made_evidence(spark, sf), supports).na.fill("", ["answer", "rule"])


NUMBERED = f"""{CLAIMS}, every_source as (select answer_id, cite, row_number() over (partition by answer_id order by min(evidence_pos)) number, string_agg(chunk_id, ',' order by evidence_pos) chunk_ids from known group by answer_id, cite)"""


@query("build_citations", f"with {NUMBERED} select answer_id, number, cite, chunk_ids from every_source")
def build_citations(spark, sf):
    return citations.numbered(made_evidence(spark, sf)).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query("source_cards", f"""with {NUMBERED},
  quotes as (select answer_id, cite, string_agg('<p>&lt;' || chunk_id || '&gt; &amp; text</p>', '' order by evidence_pos) quotes from known group by answer_id, cite)
  select answer_id, number, '<article class="source-card"><b>NGUỒN [' || number || ']</b><p>' || cite || '</p><details><summary>Xem evidence</summary>' || quotes || '<small>Chunk: ' || replace(chunk_ids, ',', ', ') || '</small></details></article>' card
  from every_source join quotes using (answer_id, cite)""")
def source_cards(spark, sf):
    rows = made_evidence(spark, sf).withColumn("text", F.concat(F.lit("<"), "chunk_id", F.lit("> & text")))
    return citations.cards(citations.numbered(rows), rows)


FOCUS = [
    (1, 1, "Điều kiện chuyển nhượng", "Chương I", "người sử dụng đất được chuyển nhượng quyền sử dụng đất khi có các điều kiện sau đây", 0.5), (1, 2, "Thủ tục", "Chương II", "trình tự thủ tục", 0.9),
    (1, 3, None, None, "cá nhân có điều kiện", 0.9), (2, 1, "Quyền", None, "quyền và nghĩa vụ của tổ chức kinh tế", 0.1), (2, 2, "x", "y", "z", 0.1), (2, 3, "x", "y", "z", 0.1),
]
FOCUS_QUERIES = {1: "điều kiện chuyển nhượng quyền sử dụng đất của cá nhân", 2: "quyền của doanh nghiệp"}


def focus_sql() -> str:
    rows = values([(q, p, t, c, b, int(s * 10), FOCUS_QUERIES[q]) for q, p, t, c, b, s in FOCUS], "query_id, pos, article_title, chapter, body, score10, query")
    has = lambda column, phrases: " + ".join(f"(contains(query, '{p}') and contains({column}, '{p}'))::int" for p in phrases)
    subjects = " + ".join(f"(contains(query, '{s}') and {any_sql('everything', names)})::int" for s, names in V.LEGAL_SUBJECTS.items())
    stop = ", ".join(map(quoted, V.FOCUS_STOPWORDS))
    cover = lambda column: f"(case when len(terms) = 0 then 0::double else len(list_filter(terms, lambda x: contains({column}, x)))::double / len(terms) end)"
    return f"""with base as (select *, lower(coalesce(article_title, '')) title, trim(lower(concat_ws(' ', coalesce(chapter, ''), '', '', coalesce(article_title, ''), '', ''))) heading0, lower(body) bodyl,
        list_filter(list_distinct(regexp_extract_all(query, '[0-9a-zà-ỹđ]+')), lambda x: length(x) > 1 and x not in ({stop})) terms from {rows}),
      b2 as (select *, regexp_replace(heading0, '\\s+', ' ', 'g') heading from base),
      b3 as (select *, heading || ' ' || bodyl everything from b2),
      s as (select query_id, pos, score10, round(12.0::double * (({' + '.join(f"contains(query, '{a}')::int" for a in V.LEGAL_ACTIONS)}) > 0 and contains(query, 'điều kiện') and {any_sql('bodyl', V.RIGHTS_PHRASES)} and {any_sql('bodyl', V.CONDITION_PHRASES)})::int
        + 6.0::double * ({has('title', V.LEGAL_INTENTS)}) + 5.0::double * ({has('everything', V.LEGAL_ACTIONS)}) + 2.0::double * ({has('everything', V.LEGAL_INTENTS)}) + 1.5::double * ({subjects}) + 3.0::double * {cover('heading')} + {cover('bodyl')}, 6) legal_focus_score from b3)
      select query_id, pos, legal_focus_score, (row_number() over (partition by query_id order by legal_focus_score desc, score10 desc, pos))::bigint comparison_rank from s"""


@query("focus_rerank", focus_sql())
def focus_rerank(spark, sf):
    rows = [(q, p, t, c, b, s, FOCUS_QUERIES[q]) for q, p, t, c, b, s in FOCUS]
    df = spark.createDataFrame(rows, "query_id long, pos long, article_title string, chapter string, text string, score double, query string")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("section", "article", "clause", "point")})
    return comparison.focus_ranked(df).select("query_id", "pos", "legal_focus_score", "comparison_rank")


DRAFT = f"""case item_id % 4 when 3 then concat('không mục', chr(10), {PHRASE}) when 2 then concat('2. ', {PHRASE}, chr(10), '1. y') else concat('mở đầu', chr(10), '1. Quy định năm 2013: ', {PHRASE}, ' [ nguồn 1 ]', chr(10), '- thêm', chr(10), '2. b [Nguồn  2]',
  chr(10), chr(10), '3.Điểm giống: c', chr(10), '4. Điểm khác/thay đổi: d') end"""
HEADS = "[" + ", ".join(f"'{h}'" for h in V.COMPARISON_SECTIONS) + "]"


@query("canonical_sections", f"""with d0 as (select item_id answer_id, string_split(regexp_replace({DRAFT}, '(?i)\\[\\s*Nguồn\\s+([0-9]+)\\s*\\]', '[Nguồn \\1]', 'g'), chr(10)) x from benchmark),
  d1 as (select answer_id, trim(unnest(x)) line, generate_subscripts(x, 1) line_no from d0), d2 as (select *, case when regexp_matches(line, '^[1-4]\\.') then line[1:1]::int end number, regexp_replace(line, '^[1-4]\\.\\s*', '') rest from d1 where line <> ''),
  d3 as (select *, count(number) over (partition by answer_id order by line_no rows between unbounded preceding and current row) section, {HEADS}[number] full_head from d2),
  d4 as (select *, case when number is not null then case when starts_with(rest, substr(full_head, 4)) then number || '. ' || rest else rtrim(full_head || ' ' || rest) end when section > 0 then regexp_replace(line, '^[-*•]\\s*', '') else line end out_line from d3),
  d5 as (select answer_id, case when section > 0 then section + 1000000000 else line_no end unit, string_agg(out_line, ' ' order by line_no) piece from d4 where out_line <> '' group by all),
  d6 as (select answer_id, string_agg(piece, chr(10) order by unit) answer from d5 group by answer_id), d7 as (select *, list_transform({HEADS}, lambda h: strpos(answer, h)) places from d6)
  select answer_id, answer, places[1] > 0 and places[2] > 0 and places[3] > 0 and places[4] > 0 and places[1] <= places[2] and places[2] <= places[3] and places[3] <= places[4] as structured from d7""")
def canonical_sections(spark, sf):
    rows = comparison.canonical(spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("answer_id"), F.expr(DRAFT).alias("answer")))
    return rows.withColumn("structured", comparison.structured(F.col("answer")))


MAPPINGS = [
    (1, 0, V.COMPARISON_SECTIONS[0] + " a", ["o1"]), (1, 1, V.COMPARISON_SECTIONS[1] + " b", ["n1", "n2"]), (1, 2, V.COMPARISON_SECTIONS[2] + " c", ["o1", "n1"]), (1, 3, V.COMPARISON_SECTIONS[3] + " d", ["o1"]),
    (1, 4, "ngoài", ["o1"]), (1, 5, V.COMPARISON_SECTIONS[0] + " e", ["n1"]), (1, 6, V.COMPARISON_SECTIONS[1] + " f", ["o1", "n1"]), (2, 0, V.COMPARISON_SECTIONS[0] + " g", ["s"]),
]
SIDES = [(1, "2013", "o1"), (1, "current", "n1"), (1, "current", "n2"), (2, "2013", "s"), (2, "current", "s")]


@query("mapping_rules", f"""with m as (select answer_id, line_no, claim, string_split(ids, ',') ids from {values([(a, n, c, ','.join(i)) for a, n, c, i in MAPPINGS], 'answer_id, line_no, claim, ids')}),
  s as (select * from {values(SIDES, 'answer_id, side, chunk_id')}), p as (select answer_id, list(chunk_id) filter (side = '2013') o, list(chunk_id) filter (side = 'current') n from s group by answer_id),
  j as (select *, case {' '.join(f"when starts_with(claim, '{h}') then {k}" for k, h in enumerate(V.COMPARISON_SECTIONS, 1))} end sec from m join p using (answer_id)),
  r as (select answer_id::bigint answer_id, line_no::bigint line_no, case when sec is null then 'claim_outside_sections' when sec = 1 and not list_has_all(o, ids) then 'old_section_cites_other_side'
    when sec = 2 and not list_has_all(n, ids) then 'current_section_cites_other_side' when sec >= 3 and not (list_has_any(o, ids) and list_has_any(n, ids)) then 'shared_section_lacks_a_side' end rule from j)
  select * from r where rule is not null union all select answer_id, -1, 'chunk_on_both_sides' from p where list_has_any(o, n)""")
def mapping_rules(spark, sf):
    rows = spark.createDataFrame(MAPPINGS, "answer_id long, line_no long, claim string, chunk_ids array<string>")
    return comparison.mapping_violations(rows, spark.createDataFrame(SIDES, "answer_id long, side string, chunk_id string")).na.fill(-1, ["line_no"])


SPOKEN = [*speech.NUMBERS.items(), ("một trăm hai mươi", None), ("mười mốt", None), ("hai mươi không", None)]
HEARD = values([(k, phrase, n) for k, (phrase, n) in enumerate(SPOKEN)], "nth, phrase, number")


@query("transcript_normalize", f"""with w as {HEARD}, d as (select doc_id, doc_id % {len(SPOKEN)} a, (doc_id * 7 + 3) % {len(SPOKEN)} b from documents)
  select doc_id, 'theo ' || coalesce('Điều ' || x.number, 'ĐIỀU ' || x.phrase) || ', ' || coalesce('Khoản ' || y.number, 'khoản ' || y.phrase) || ' Điểm ' || chr((97 + doc_id % 26)::int) || ' năm 2024, năm 2013 của luật' transcript
  from d join w x on x.nth = a join w y on y.nth = b""")
def transcript_normalize(spark, sf):
    phrases = F.array(*[F.lit(p) for p, _ in SPOKEN])
    said = lambda k: F.get(phrases, (k % len(SPOKEN)).cast("int"))
    d = F.col("doc_id")
    spoken = F.concat(F.lit("theo  ĐIỀU "), said(d), F.lit(",  khoản\t"), said(d * 7 + 3), F.lit(" điểm "), F.upper(F.expr("chr(97 + doc_id % 26)")), F.lit(" năm hai nghìn không trăm hai mươi bốn, NĂM hai nghìn không trăm mười ba  của luật"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", speech.transcript(spoken).alias("transcript"))


SAID = "concat(text, ' [', cast(item_id as string), '][2].', chr(10), 'Và [Nguồn 3] nữa [1, 2; 3]', chr(10), chr(10), case when item_id % 3 = 0 then 'Căn cứ pháp lý: giữa dòng [x]' else 'Căn cứ pháp lý:' end, chr(10), '[1] Luật')"


@query("speech_text", f"select item_id, trim(regexp_replace(regexp_replace(string_split_regex({SAID}, '(?m)^Căn cứ pháp lý:\\s*$')[1], '(?i)\\[(?:Nguồn\\s+)?[0-9]+(?:\\s*[,;]\\s*[0-9]+)*\\]', '', 'g'), '\\s+', ' ', 'g')) spoken from benchmark")
def speech_text(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", speech.speakable(F.expr(SAID)).alias("spoken"))


@query("table_rows", """with c as (select doc_id, unnest(string_split(text, '|')) cell, generate_subscripts(string_split(text, '|'), 1) k from documents),
  n as (select doc_id, k, array_to_string(list_transform(string_split(replace(replace(replace(cell, chr(8203), ''), chr(160), ' '), chr(13), chr(10)), chr(10)), lambda p: regexp_replace(regexp_replace(p, '[ \\t\\f\\v]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), ' ') c from c),
  kept as (select *, lag(c) over (partition by doc_id order by k) p from n where c <> ''), lines as (select doc_id, string_agg(c, ' | ' order by k) line from kept where p is null or p <> c group by doc_id)
  select doc_id, md5(coalesce(line, '')) digest, len(coalesce(line, ''))::int size from documents left join lines using (doc_id)""")
def table_rows(spark, sf):
    from evidence_engine.operators.cleaning import table_line

    line = F.coalesce(table_line(F.split("text", r"\|")), F.lit(""))
    rows = spread(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", line.alias("line"))
    return rows.select("doc_id", F.md5("line").alias("digest"), F.length("line").alias("size"))


LABELLED = "concat('[Nguồn ', cast(turn + 1 as string), ']', chr(10), text, ' [nguồn  ', cast(conv_id as string), '] [Nguồn x]')"


@query("shifted_labels", f"""with x as (select conv_id, turn, {LABELLED} c from conversations), y as (select *, string_split_regex(c, '(?i)\\[Nguồn\\s+[0-9]+\\]') parts, regexp_extract_all(c, '(?i)\\[Nguồn\\s+([0-9]+)\\]', 1) labels from x)
  select conv_id, turn, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || case when i <= len(labels) then '[Nguồn ' || (labels[i]::bigint + 3) || ']' else '' end), '') context from y""")
def shifted_labels(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    return rows.select("conv_id", "turn", comparison.shifted(F.expr(LABELLED), 3).alias("context"))
