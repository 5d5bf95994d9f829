"""The engine: build indexes from chunks, answer questions, compare versions. A batch of questions is one plan.

Models stay outside. encode(list of texts) gives vectors and generate(list of message lists) gives texts;
both run on Arrow batches in the workers.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from evidence_engine import prompts
from evidence_engine.functions import vocabulary as V
from evidence_engine.functions.intents import route_intent, topic
from evidence_engine.functions.text import prefixed
from evidence_engine.operators import citations, comparison, dense, evidence, fusion, lexical
from evidence_engine.sources import tables
from evidence_engine.sources.scratch import written


class Retriever(Protocol):
    def search(self, queries: DataFrame, top_k: int) -> DataFrame:
        """(query_id, chunk_id, rank, score) of queries (query_id, query)."""


def encoded(text: Column, encode: Callable[[list[str]], list[list[float]]], batch: int = 32) -> Column:
    """Vectors of texts."""

    @pandas_udf("array<double>")
    def run(s):
        import pandas as pd

        texts, out = s.tolist(), []
        for k in range(0, len(texts), batch):
            out += [list(map(float, v)) for v in encode(texts[k : k + batch])]
        return pd.Series(out)

    return run(text)


def generated(messages: Column, generate: Callable[[list[list[dict]]], list[str]]) -> Column:
    """Texts that a generator makes of message lists."""

    @pandas_udf("string")
    def run(s):
        import pandas as pd

        return pd.Series(generate([[dict(m) for m in ms] for ms in s]))

    return run(messages)


@dataclass
class LexicalRetriever:
    postings: DataFrame
    stats: DataFrame
    chunks: DataFrame
    config: lexical.BM25 = field(default_factory=lexical.BM25)

    def search(self, queries: DataFrame, top_k: int) -> DataFrame:
        asked = lexical.with_references(queries, self.chunks.select("document_id", "document_title"))
        return lexical.search(self.postings, self.stats, asked, self.chunks, top_k, self.config).select("query_id", "chunk_id", "rank", "score", "bm25_score")


@dataclass
class DenseRetriever:
    vectors: DataFrame  # vec_id, chunk_id, embedding
    encode: Callable
    prefix: str = "query: "

    def search(self, queries: DataFrame, top_k: int) -> DataFrame:
        asked = queries.select("query_id", encoded(prefixed(F.col("query"), self.prefix), self.encode).alias("embedding"))
        asked = asked.withColumn("embedding", dense.unit(F.col("embedding")))
        return dense.search(self.vectors, asked, top_k).join(self.vectors.select("vec_id", "chunk_id"), "vec_id").select("query_id", "chunk_id", "rank", F.col("vector_score").alias("score"))


@dataclass
class HybridRetriever:
    lexical: Retriever
    dense: Retriever
    chunks: DataFrame
    config: fusion.Hybrid = field(default_factory=fusion.Hybrid)

    def search(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        k = top_k or self.config.final_top_k
        rows = fusion.fused(self.lexical.search(queries, self.config.bm25_top_n), self.dense.search(queries, self.config.vector_top_n), self.config.rrf_k)
        rows = rows.join(lexical.with_references(queries), "query_id").join(self.chunks, "chunk_id")
        rows = rows.withColumn("exact_match_count", fusion.exact_matches("document_id", "article", "clause"))
        return fusion.final_ranked(fusion.version_boosted(rows, self.config), k).withColumn("score", F.col("final_score"))


@dataclass
class Engine:
    retriever: Retriever
    chunks: DataFrame
    generate: Callable[[list[list[dict]]], list[str]]
    context_tokens: int = 2600
    top_k: int = 6
    top_k_per_side: int = 4
    retries: int = 2
    strict: bool = True
    overfetch: int = 1
    written: Callable[[DataFrame], DataFrame] = written
    tokens: evidence.Tokens = evidence.WORDS
    most_prompt_tokens: int | None = 7000

    def kept(self, df: DataFrame) -> DataFrame:
        """A small table that several later ones read, or generated text, which is made once: written and read again."""
        return self.written(df)

    def hits(self, queries: DataFrame, top_k: int) -> DataFrame:
        found = self.retriever.search(queries, top_k)
        extra = [c for c in ("final_score", "score") if c in found.columns]
        # everything about evidence goes back to these few rows several times
        rows = self.kept(found.select("query_id", "chunk_id", F.col("rank").alias("pos"), *extra))
        return rows.join(queries.select("query_id", "query"), "query_id").join(self.chunks, "chunk_id")

    def context(self, hits: DataFrame) -> DataFrame:
        """Evidence rows (query_id, evidence_pos, chunk_id, block, metadata) in order and within budget."""
        price = self.tokens.count(evidence.block(F.lit(1), evidence.path_of(), F.col("text")))
        order = self.kept(evidence.expanded(self.kept(hits), self.chunks, self.context_tokens, price))
        rows = order.join(self.chunks, "chunk_id").withColumn("block", evidence.block(F.col("evidence_pos"), evidence.path_of(), F.col("text")))
        packed = evidence.packed(rows.select("query_id", "evidence_pos", "block"), self.context_tokens, self.tokens)
        return packed.join(rows.drop("block"), ["query_id", "evidence_pos"])

    def made(self, messages: Column) -> Column:
        """What the generator makes of messages; a prompt of more than most_prompt_tokens is an error."""
        if self.most_prompt_tokens is None:
            return generated(messages, self.generate)
        size = self.tokens.count(F.array_join(F.transform(messages, lambda m: m["content"]), "\n"))
        checked = F.when(size > self.most_prompt_tokens, F.raise_error(F.lit(f"a prompt has more than {self.most_prompt_tokens} tokens; lower context_tokens"))).otherwise(messages)
        return generated(checked, self.generate)

    @staticmethod
    def joined(rows: DataFrame) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("evidence_pos", "block")))
        return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda b: b["block"]), "\n\n").alias("context"))

    def ask(self, queries: DataFrame) -> DataFrame:
        """query_id, mode, answer and rule of every question; rule names what made an answer unfit. A blank question is an error."""
        asked = F.when(F.trim(F.coalesce("query", F.lit(""))) == "", F.raise_error(F.lit("empty question"))).otherwise(F.col("query"))
        routed = queries.withColumn("query", asked).withColumn("mode", route_intent(F.col("query")))
        plain = self.answer(routed.where("mode = 'qa'")).withColumn("mode", F.lit("qa"))
        both = self.compare(routed.where("mode = 'comparison'")).withColumn("mode", F.lit("comparison"))
        return plain.unionByName(both)

    def answer(self, queries: DataFrame) -> DataFrame:
        """query_id, answer, rule. Questions without evidence never reach the generator."""
        hits = evidence.isolated(self.hits(queries, max(self.top_k * self.overfetch, 20) if self.overfetch > 1 else self.top_k))
        hits = hits.withColumn("nth", F.row_number().over(fusion.Window.partitionBy("query_id").orderBy("pos"))).where(F.col("nth") <= self.top_k).drop("nth")
        sources = self.kept(self.context(hits))
        asked = queries.join(self.joined(sources), "query_id")
        raw = self.kept(asked.select(F.col("query_id").alias("answer_id"), self.made(prompts.question_messages(F.col("query"), F.col("context"))).alias("answer")))
        refused = F.trim("answer") == V.NO_EVIDENCE
        tagged, used = raw.where(~refused), sources.withColumnRenamed("query_id", "answer_id")
        used = used.join(tagged.select("answer_id"), "answer_id", "left_semi")
        wrong = citations.violations(tagged, used, self.strict).groupBy("answer_id").agg(F.min("rule").alias("rule"))
        fit = tagged.join(wrong, "answer_id", "left_anti")
        out = citations.rendered(fit, used.join(fit.select("answer_id"), "answer_id", "left_semi")).withColumn("rule", F.lit(None).cast("string"))
        out = out.unionByName(wrong.select("answer_id", F.lit(None).cast("string").alias("answer"), "rule"))
        out = out.unionByName(raw.where(refused).select("answer_id", F.lit(V.NO_EVIDENCE).alias("answer"), F.lit(None).cast("string").alias("rule")))
        none = queries.join(raw.select(F.col("answer_id").alias("query_id")), "query_id", "left_anti")
        out = out.unionByName(none.select(F.col("query_id").alias("answer_id"), F.lit(V.NO_EVIDENCE).alias("answer"), F.lit(None).cast("string").alias("rule")))
        return out.withColumnRenamed("answer_id", "query_id")

    def sides(self, queries: DataFrame) -> DataFrame:
        """Evidence of both sides, each searched for on its own, isolated and ranked by focus; places count on from the first side."""
        found = None
        for side, suffix in (("2013", " Luật Đất đai 2013 45/2013/QH13"), ("current", " Luật Đất đai 2024 31/2024/QH15 hiện hành")):
            asked = queries.select("query_id", topic(F.col("query")).alias("topic")).withColumn("query", F.concat("topic", F.lit(suffix)))
            rows = evidence.by_side(self.hits(asked, 4 * self.top_k_per_side)).where(F.col("side") == side)
            rows = rows.drop("query").join(asked.select("query_id", F.col("topic").alias("query")), "query_id")
            ranked = comparison.focus_ranked(rows, self.top_k_per_side).withColumn("pos", F.col("comparison_rank"))
            part = self.context(ranked.select("query_id", "query", "pos", *[c for c in self.chunks.columns])).withColumn("side", F.lit(side))
            found = part if found is None else found.unionByName(part)
        first = found.where("side = '2013'").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        moved = found.join(first, "query_id", "left").withColumn("at", F.when(F.col("side") == "2013", F.col("evidence_pos")).otherwise(F.col("evidence_pos") + F.coalesce("n", F.lit(0))))
        relabelled = F.concat(F.lit("[Nguồn "), F.col("at").cast("string"), F.lit("]"), F.regexp_replace("block", r"^\[Nguồn [0-9]+\]", ""))
        return moved.withColumn("block", relabelled).withColumn("evidence_pos", F.col("at")).drop("at", "n")

    def compare(self, queries: DataFrame) -> DataFrame:
        """query_id, answer, rule of comparisons; sections 1-2 and 3-4 are made apart, each in at most 1 + retries rounds.

        A round generates only for questions whose last output broke a rule.
        """
        sources = self.kept(self.sides(queries))
        of = lambda side: self.joined(sources.where(F.col("side") == side))
        asked = queries.join(of("2013").withColumnRenamed("context", "old"), "query_id").join(of("current").withColumnRenamed("context", "new"), "query_id")
        used = sources.withColumnRenamed("query_id", "answer_id")
        pools = used.select("answer_id", "side", "chunk_id")
        parts, failed = None, None
        for sections in ((1, 2), (3, 4)):
            base = asked.select(F.col("query_id").alias("answer_id"), prompts.comparison_messages(F.col("query"), F.col("old"), F.col("new"), sections).alias("base"))
            pending = base.withColumn("messages", F.col("base"))
            for attempt in range(self.retries + 1):
                raw = self.kept(pending.select("answer_id", "base", self.made(F.col("messages")).alias("answer")))
                tidy = self.kept(comparison.canonical(raw.select("answer_id", "answer")))
                lines = F.filter(F.split("answer", "\n"), lambda x: F.trim(x) != "")
                heads = [V.COMPARISON_SECTIONS[k - 1] for k in sections]
                shaped = (F.size(lines) == 2) & F.startswith(F.get(lines, F.lit(0)), F.lit(heads[0])) & F.startswith(F.get(lines, F.lit(1)), F.lit(heads[1]))
                mine = used.join(tidy.select("answer_id"), "answer_id", "left_semi")
                wrong = tidy.where(~shaped).select("answer_id", F.lit("wrong_sections").alias("rule"))
                wrong = wrong.unionByName(citations.violations(tidy, mine).select("answer_id", "rule"))
                wrong = wrong.unionByName(comparison.mapping_violations(citations.tagged(tidy, mine), pools.join(tidy.select("answer_id"), "answer_id", "left_semi")).select("answer_id", "rule"))
                wrong = self.kept(wrong.groupBy("answer_id").agg(F.min("rule").alias("rule")))
                good = tidy.join(wrong, "answer_id", "left_anti").withColumn("part", F.lit(sections[0]))
                parts = good if parts is None else parts.unionByName(good)
                if attempt == self.retries:
                    bad = raw.select("answer_id").join(wrong, "answer_id", "left").join(good.select("answer_id"), "answer_id", "left_anti").withColumn("rule", F.coalesce("rule", F.lit("wrong_sections")))
                    failed = bad if failed is None else failed.unionByName(bad)
                pending = self.kept(raw.join(good.select("answer_id"), "answer_id", "left_anti").select("answer_id", "base", prompts.retry_messages(F.col("base"), F.col("answer"), sections).alias("messages")))
                if pending.isEmpty():
                    break
        whole = parts.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "answer"))), lambda p: p["answer"]), "\n").alias("answer")).where("n = 2").drop("n")
        whole = self.kept(whole.where(comparison.structured(F.col("answer"))))
        out = citations.rendered(whole, used.join(whole.select("answer_id"), "answer_id", "left_semi")).withColumn("rule", F.lit(None).cast("string"))
        if failed is not None:
            out = out.unionByName(failed.groupBy("answer_id").agg(F.min("rule").alias("rule")).select("answer_id", F.lit(None).cast("string").alias("answer"), "rule"))
        none = queries.join(asked.select("query_id"), "query_id", "left_anti")
        out = out.unionByName(none.select(F.col("query_id").alias("answer_id"), F.lit(V.NO_COUNTERPART).alias("answer"), F.lit(None).cast("string").alias("rule")))
        return out.withColumnRenamed("answer_id", "query_id")


def build(chunks: DataFrame, path: str, encode: Callable | None = None, report: DataFrame | None = None, prefix: str = "passage: ") -> dict:
    """Both indexes below path; a report with warnings stops it. Returns rows and seconds."""
    started = time.perf_counter()
    if report is not None:
        tables.report_gate(report)
    tables.save_lexical(chunks, f"{path}/lexical")
    if encode is not None:
        rows = chunks.select("chunk_pos", "chunk_id", encoded(prefixed(F.col("text"), prefix), encode).alias("embedding"))
        numbered = rows.withColumn("vec_id", (F.row_number().over(fusion.Window.orderBy("chunk_pos", "chunk_id")) - 1).cast("long"))
        tables.save_dense(numbered.select("vec_id", "chunk_id", "embedding"), f"{path}/dense", chunks=tables.digest(chunks))
    seconds = time.perf_counter() - started
    n = chunks.count()
    return {"chunks": n, "seconds": seconds, "chunks_per_second": n / seconds}


def load(spark: SparkSession, path: str, encode: Callable, generate: Callable, **options) -> Engine:
    """An engine over stored indexes; vectors of other chunks are an error."""
    postings, stats, chunks = tables.load_lexical(spark, f"{path}/lexical")
    vectors = tables.load_dense(spark, f"{path}/dense", chunks)
    return Engine(HybridRetriever(LexicalRetriever(postings, stats, chunks), DenseRetriever(vectors, encode), chunks), chunks, generate, **options)
