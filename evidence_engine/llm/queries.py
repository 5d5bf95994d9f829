"""The thin queries opN_<name> over the driver's tables, and their SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from evidence_engine.llm import bpe, context_tree, jaccard_join, mixing, pii, quality, suffix_dedup, token_files, top_k, url_filter
from evidence_engine.llm.common import bounded_batches, documents

def bounded(fn):
    """The query with batches of bounded size."""

    @wraps(fn)
    def run(spark, sf_dir):
        bounded_batches(spark)
        return fn(spark, sf_dir)

    return run


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.spans(documents(spark, sf_dir, "doc_id", "text")).drop("spans", "kept")


def op2_pii(spark, sf_dir):
    return pii.found(documents(spark, sf_dir, "doc_id", "text"))


def op3_token_files(spark, sf_dir):
    return token_files.tokenize(documents(spark, sf_dir, "doc_id", "text"), tokenizer_file())


def op6_context_tree(spark, sf_dir):
    return context_tree.scored(documents(spark, sf_dir, "doc_id", "text"), context_tree.DEPTH)


def op7_bpe(spark, sf_dir):
    return bpe.round_trip(documents(spark, sf_dir, "doc_id", "text"), tokenizer_file())


def op4_url_filter(spark, sf_dir):
    return url_filter.judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).withColumn("score", F.round("score", 6))


def op5_mixing(spark, sf_dir):
    return mixing.taken(documents(spark, sf_dir, "doc_id", "text", "source"))


def op8_jaccard_join(spark, sf_dir):
    return jaccard_join.linked(documents(spark, sf_dir, "doc_id", "text"))


def op9_quality(spark, sf_dir):
    return quality.judged(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_top_k(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k.top_k(vectors, F.col("vec_id") % 50 == 0)


def url_sql() -> str:
    """The rules, both models context by context, and the threshold; places in URLs are looked up by their longest kept context."""
    order, letters = url_filter.ORDER, ", ".join(f"'{c}'" for c in url_filter.LETTERS)
    fits = lambda host, path: f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}')"
    ranked = [(v, r, *r.split("/", 1)) for v, r in sorted(url_filter.RULES, key=lambda x: (-len(x[1]), x[1]))]
    chosen = lambda k: "case " + " ".join(f"when {fits(r[2], r[3])} then '{r[k]}'" for r in ranked) + " end"
    levels = "".join(
        f""",
        p{d} as (select a.context, a.letter, case when all1 = 0 then q.p1 else (coalesce(n1, 0) + kinds1 * q.p1) / (all1 + kinds1) end p1, case when all0 = 0 then q.p0 else (coalesce(n0, 0) + kinds0 * q.p0) / (all0 + kinds0) end p0
          from (select *, unnest([{letters}]) letter from kept where depth = {d}) a left join counts c on c.depth = {d} and c.context = a.context and c.letter = a.letter join p{d - 1} q on q.context = substr(a.context, 2) and q.letter = a.letter)"""
        for d in range(1, order + 1)
    )
    return f"""
        with located as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
        parts as (select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from located),
        ruled as (select *, {chosen(1)} as rule, {chosen(0)} as ruling,
          regexp_replace(translate(lower(coalesce(url, '')), '123456789', '000000000'), '[^a-z0/.\\-_?=&%:#@~+]', '{url_filter.OTHER}', 'g') x from parts),
        examples as (select x, (ruling = 'allow')::int good, ('0x' || substr(md5(url), 1, 8))::bigint % 5 fold from ruled where ruling is not null),
        places as (select good, '{url_filter.START * order}' || x x, unnest(range(1, length(x) + 1)) i from examples where fold <> 0),
        grams as (select good, substr(x, i + {order}, 1) letter, depth, substr(x, i + {order} - depth, depth) context from places, (select unnest(range(0, {order + 1})) depth)),
        counts as (select depth, context, letter, sum(good)::double n1, sum(1 - good)::double n0 from grams group by all),
        contexts as (select depth, context, sum(n1 + n0) n, sum(n1) all1, sum(n0) all0, count(*) filter (n1 > 0) kinds1, count(*) filter (n0 > 0) kinds0 from counts group by all),
        kept as (select * from contexts where depth = 0 or n * {url_filter.SHARE} >= (select count(*) from places)),
        p0 as (select a.context, a.letter, (coalesce(n1, 0) + 1) / (all1 + {url_filter.A}) p1, (coalesce(n0, 0) + 1) / (all0 + {url_filter.A}) p0
          from (select *, unnest([{letters}]) letter from kept where depth = 0) a left join counts c on c.depth = 0 and c.letter = a.letter){levels},
        p as ({" union all ".join(f"select * from p{d}" for d in range(order + 1))}),
        urls as (select page_id, '{url_filter.START * order}' || x x, unnest(range(1, length(x) + 1)) i from ruled),
        seen as (select page_id, i, letter, arg_max(context, depth) context from (select page_id, i, substr(x, i + {order}, 1) letter, depth, substr(x, i + {order} - depth, depth) context from urls, (select unnest(range(0, {order + 1})) depth)) g join kept using (depth, context) group by all),
        scores as (select page_id, sum(ln(p1 / p0)) / count(*) score from seen join p using (context, letter) group by page_id),
        scored as (select r.*, coalesce(score, 0) score from ruled r left join scores using (page_id)),
        held as (select greatest(-{url_filter.GRID}, least({url_filter.GRID}, floor(score / {url_filter.STEP})))::int cell, (ruling = 'allow')::int good from scored where ruling is not null and ('0x' || substr(md5(url), 1, 8))::bigint % 5 = 0),
        grid as (select cell, (select coalesce(sum(good), 0) from held h where h.cell < g.cell) lost, (select coalesce(sum(1 - good), 0) from held h where h.cell < g.cell) caught from (select unnest(range(-{url_filter.GRID}, {url_filter.GRID + 2})) cell) g),
        sides as (select coalesce(sum(good), 0) good, coalesce(sum(1 - good), 0) bad from held),
        best as (select case when bad = 0 then '-infinity'::double when good = 0 then 'infinity'::double else {url_filter.STEP} * (select arg_max(cell, (coalesce(caught / nullif(bad, 0), 0) - coalesce(lost / nullif(good, 0), 0), -abs(cell), cell)) from grid) end least from sides)
        select page_id, host, path, rule, coalesce(ruling, case when score >= least then 'allow' else 'block' end) verdict, round(score, 6) score from scored, best"""


QUERIES = {f.__name__: bounded(f) for f in (op1_suffix_dedup, op2_pii, op3_token_files, op4_url_filter, op5_mixing, op6_context_tree, op7_bpe, op8_jaccard_join, op9_quality, op10_top_k)}
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
        windows as (select doc_id, s, substr(x, 2 * s + 1, 200) w from (select doc_id, x, unnest(range(0, greatest(0, length(x) // 2 - 99))) s from d)),
        first as (select w, min((doc_id, s)) f from windows group by w having count(*) > 1),
        again as (select doc_id, s from windows join first using (w) where (doc_id, s) <> f),
        marked as (select *, coalesce(s > lag(s) over (partition by doc_id order by s) + 100, true) opens from again),
        runs as (select doc_id, min(s) a, max(s) + 100 b from (select *, sum(opens::int) over (partition by doc_id order by s) r from marked) group by doc_id, r),
        cuts as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) p from runs),
        gaps as (select doc_id, sum(b - a) n_removed, count(*) n_spans, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' order by a) || substr(any_value(x), 2 * max(b) + 1) kept from cuts join d using (doc_id) group by doc_id)
        select d.doc_id, (length(x) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(coalesce(kept, x))) kept_sha256
        from d left join gaps using (doc_id)""",
    "op4_url_filter": url_sql(),
    "op5_mixing": """
        with sized as (
          select doc_id, coalesce(source, '') src, source is null no_source,
                 len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) size,
                 ('0x' || substr(md5('17:' || doc_id || ':' || md5(coalesce(text, ''))), 1, 15))::bigint key from documents),
        totals as (select src, no_source, sum(size)::bigint source_size, 2.0::double * sum(size)::double cap from sized group by all),
        weighed as (select *, list_extract([3.0::double, 1, 2], ((row_number() over (order by no_source, src)) - 1) % 3 + 1) weight from totals),
        levels as (
          select *, cap / weight fills_at, (sum(source_size) over ())::double * 1.5::double wanted from weighed),
        level as (
          select *, (wanted - coalesce(sum(cap) over (order by fills_at, no_source, src rows between unbounded preceding and 1 preceding), 0))
                    / sum(weight) over (order by fills_at, no_source, src rows between current row and unbounded following) level from levels),
        goal as (select src, no_source, source_size, least(cap, coalesce((select arg_min(level, (fills_at, no_source, src)) from level where level <= fills_at), 0) * weight) target from level),
        placed as (
          select *, coalesce(sum(size) over (partition by no_source, src order by key, doc_id rows between unbounded preceding and 1 preceding), 0) before_
          from sized join goal using (src, no_source)),
        epochs as (select *, case when source_size > 0 then round(target)::bigint // source_size else 0 end epochs from placed)
        select doc_id, size::bigint size, source_size, target,
               (epochs * size + greatest(0, least(size, round(target)::bigint - epochs * source_size - before_)))::bigint taken from epochs""",
    "op8_jaccard_join": """
        with recursive words as (
          select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
        shingles as (
          select distinct doc_id, unnest(case when w is null or len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
                                              else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) end) s from words),
        sizes as (select doc_id, count(*) n from shingles group by doc_id),
        common as (select a.doc_id a, b.doc_id b, count(*) c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
        links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
        reach as (select doc_id, doc_id as root from sizes union select l.b, r.root from reach r join links l on l.a = r.doc_id where r.root < l.b),
        least as (select doc_id, min(root) root from reach group by doc_id)
        select d.doc_id, coalesce(n, 0)::bigint n_shingles, coalesce(root, d.doc_id) component_id
        from documents d left join sizes s on s.doc_id = d.doc_id left join least r on r.doc_id = d.doc_id""",
    "op10_top_k": """
        with whole as (
          select vec_id, [floor(256 * x::double) for x in embedding] x from embeddings
          where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (
          select q.vec_id query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint score
          from whole q join whole c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
        ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from scored)
        select query_id, rank, vec_id, score from ranked where rank <= 5""",
}
