"""Citations: numbered sources, tagged answers and what is wrong with them.

Evidence is (answer_id, evidence_pos, chunk_id and metadata); answers are (answer_id, answer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions import vocabulary as V
from evidence_engine.functions.text import citation_text, filled

TAG = r"(?iU)\[Nguồn\s+([0-9]+)\]"
ONLY_TAGS = r"(?iU)^(?:\[Nguồn\s+[0-9]+\]\s*)+$"


class CitationError(ValueError):
    """An answer that its evidence doesn't carry."""


def identified(evidence: DataFrame) -> DataFrame:
    """Adds cite: the short form of each row's source. Repeated chunks keep their first place."""
    rows = evidence.withColumn("chunk_id", filled(F.col("chunk_id"))).withColumn("cite", citation_text(*map(F.col, ("document_title", "document_id", "article", "clause", "point"))))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("answer_id", "chunk_id").orderBy("evidence_pos"))).where("nth = 1").drop("nth")


def numbered(evidence: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """(answer_id, number, cite, chunk_ids): sources of what is cited (answer_id, chunk_id; None: everything), by first place."""
    rows = identified(evidence)
    if cited is not None:
        rows = rows.join(cited.select("answer_id", filled(F.col("chunk_id")).alias("chunk_id")).distinct(), ["answer_id", "chunk_id"], "left_semi")
    groups = rows.groupBy("answer_id", "cite").agg(F.min("evidence_pos").alias("first"), F.array_sort(F.collect_list(F.struct("evidence_pos", "chunk_id"))).alias("ids"))
    number = F.row_number().over(Window.partitionBy("answer_id").orderBy("first"))
    return groups.select("answer_id", number.cast("long").alias("number"), "cite", F.transform("ids", lambda r: r["chunk_id"]).alias("chunk_ids"))


def unknown(evidence: DataFrame, cited: DataFrame) -> DataFrame:
    """Cited chunks that no evidence has."""
    rows = cited.select("answer_id", filled(F.col("chunk_id")).alias("chunk_id")).where("chunk_id is not null").distinct()
    return rows.join(identified(evidence).select("answer_id", "chunk_id"), ["answer_id", "chunk_id"], "left_anti")


def ungrouped(answer: Column) -> Column:
    """[Nguồn 1, Nguồn 2] as [Nguồn 1] [Nguồn 2]: the comma between two of a bracket's tags ends one and starts the next."""
    inner = r"(?iU)(?<=Nguồn)(\s+[0-9]+)\s*,\s*(?=Nguồn\s+[0-9]+(?:\s*,\s*Nguồn\s+[0-9]+)*\])"
    # only inside a bracket that starts with a tag
    marked = F.regexp_replace(answer, r"(?iU)(\[(?:Nguồn\s+[0-9]+\s*,\s*)+Nguồn\s+[0-9]+\])", "\u0001$1\u0002")
    parts = F.split(marked, "[\u0001\u0002]")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(F.regexp_replace(p, inner, "$1] ["), r"(?iU)Nguồn\s+([0-9]+)", "Nguồn $1")).otherwise(p)), "")


def claim_lines(answers: DataFrame) -> DataFrame:
    """(answer_id, line_no, line) of every line; lines of tags alone are moved behind the last line with text before them.

    A line of tags without one before it keeps owner null.
    """
    text = F.regexp_replace(ungrouped(F.col("answer")), r"(?U)^\s+|\s+$", "")
    rows = answers.select("answer_id", F.posexplode(F.split(text, r"\R")).alias("line_no", "raw"))
    line = F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")
    tags = F.rlike(line, F.lit(ONLY_TAGS))
    before = Window.partitionBy("answer_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("line", line).withColumn("tags", tags)
    owner = F.last(F.when(~F.col("tags") & (F.col("line") != ""), F.col("line_no")), ignorenulls=True).over(before)
    rows = rows.withColumn("owner", F.when(F.col("tags"), owner).otherwise(F.col("line_no")))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), " ")
    return rows.groupBy("answer_id", "owner").agg(F.min("line_no").cast("long").alias("line_no"), parts.alias("line"))


def claims(answers: DataFrame) -> DataFrame:
    """(answer_id, line_no, claim, tags) of every line with text; tags: source numbers in order."""
    rows = claim_lines(answers).where("line <> '' and owner is not null")
    tags = F.transform(F.regexp_extract_all("line", F.lit(TAG), F.lit(1)), lambda t: t.cast("long"))
    return rows.select("answer_id", "line_no", F.regexp_replace(F.regexp_replace("line", TAG, ""), r"(?U)\s+$", "").alias("claim"), tags.alias("tags"), F.col("line").endswith(":").alias("heading"))


def tagged(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, line_no, claim, chunk_ids, cited): claims with what their tags mean; cited are citation numbers, each once, in order of tags."""
    tags = claims(answers).select("answer_id", "line_no", "claim", F.posexplode("tags").alias("at", "evidence_pos"))
    rows = tags.join(evidence.select("answer_id", "evidence_pos", filled(F.col("chunk_id")).alias("chunk_id")), ["answer_id", "evidence_pos"])
    numbers = numbered(evidence, rows.select("answer_id", "chunk_id")).select("answer_id", "number", F.explode("chunk_ids").alias("chunk_id"))
    rows = rows.join(numbers, ["answer_id", "chunk_id"])
    inside = F.array_sort(F.collect_list(F.struct("at", "chunk_id", "number")))
    return rows.groupBy("answer_id", "line_no", "claim").agg(inside.alias("r")).select("answer_id", "line_no", "claim", F.array_distinct(F.transform("r", lambda x: x["chunk_id"])).alias("chunk_ids"), F.array_distinct(F.transform("r", lambda x: x["number"])).alias("cited"))


def violations(answers: DataFrame, evidence: DataFrame, strict: bool = True) -> DataFrame:
    """(answer_id, line_no, rule): what makes an answer unfit. Without strict, lines without tags are allowed."""
    sizes = evidence.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n"))
    lines, rows = claim_lines(answers), claims(answers).join(sizes, "answer_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    none = F.lit(None).cast("long")
    out = answers.where(F.trim(F.coalesce("answer", F.lit(""))) == "").select("answer_id", none.alias("line_no"), F.lit("empty_answer").alias("rule"))
    out = out.unionByName(lines.where("owner is null and line <> ''").select("answer_id", "line_no", F.lit("tags_without_claim").alias("rule")))
    if strict:
        out = out.unionByName(rows.where((F.size("tags") == 0) & ~F.col("heading")).select("answer_id", "line_no", F.lit("claim_without_tag").alias("rule")))
    out = out.unionByName(rows.where(F.exists("tags", lambda t: (t < 1) | (t > F.col("n")))).select("answer_id", "line_no", F.lit("tag_not_in_evidence").alias("rule")))
    out = out.unionByName(evidence.where(filled(F.col("chunk_id")).isNull()).select("answer_id", none.alias("line_no"), F.lit("evidence_without_id").alias("rule")))
    return out.unionByName(identified(evidence).where("cite is null").select("answer_id", none.alias("line_no"), F.lit("source_without_document").alias("rule"))).distinct()


def rendered(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, answer): claims with citation marks, then the numbered sources."""
    marks = tagged(answers, evidence)
    lines = claim_lines(answers).where("owner is not null").select("answer_id", "line_no", F.regexp_replace(F.regexp_replace("line", TAG, ""), r"(?U)\s+$", "").alias("claim"))
    suffix = F.array_join(F.transform("cited", lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")
    lines = lines.join(marks.select("answer_id", "line_no", "cited"), ["answer_id", "line_no"], "left").withColumn("out", F.concat_ws(" ", "claim", F.when(F.size("cited") > 0, suffix)))
    body = lines.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "out"))), lambda r: r["out"]), "\n").alias("body"))
    cited = marks.select("answer_id", F.explode("chunk_ids").alias("chunk_id"))
    sources = numbered(evidence, cited).groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("number", "cite"))).alias("s"))
    listed = F.array_join(F.transform("s", lambda c: F.concat(F.lit("["), c["number"].cast("string"), F.lit("] "), c["cite"])), "\n")
    whole = F.when(F.col("s").isNotNull(), F.concat(F.trim("body"), F.lit(f"\n\n{V.BIBLIOGRAPHY}\n"), listed)).otherwise(F.trim("body"))
    return body.join(sources, "answer_id", "left").select("answer_id", whole.alias("answer"))


def cited(answers: DataFrame, evidence: DataFrame, supports: DataFrame | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """(answer_id, answer, rule): answers with sources that the caller names, nothing guessed.

    supports: answer_id, nth, claim and chunk_ids. With more than one source each claim's first place in the
    answer gets its marks, in order of nth. Without supports the sources are those of chosen (answer_id,
    chunk_id), or all. rule names what made an answer unfit (its text is null then): a claim that it lacks,
    or a chunk that is no evidence.
    """
    if supports is not None:
        chosen = supports.select("answer_id", F.explode("chunk_ids").alias("chunk_id"))
    sources = numbered(evidence, chosen)
    strange = answers.limit(0).select("answer_id") if chosen is None else unknown(evidence, chosen).select("answer_id").distinct()
    listed = sources.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("number", "cite", "chunk_ids"))).alias("sources"))
    rows = answers.join(listed, "answer_id", "left").join(strange.withColumn("strange", F.lit(True)), "answer_id", "left")
    line = F.array().cast("array<struct<nth:long,claim:string,chunk_ids:array<string>>>")
    if supports is not None:
        steps = F.array_sort(F.collect_list(F.struct(F.col("nth").cast("long").alias("nth"), "claim", "chunk_ids")))
        rows = rows.join(supports.groupBy("answer_id").agg(steps.alias("steps")), "answer_id", "left")
        line = F.when(F.size("sources") > 1, F.coalesce("steps", line)).otherwise(line)

    def marks(ids: Column) -> Column:
        numbers = F.transform(ids, lambda i: F.get(F.filter("sources", lambda s: F.array_contains(s["chunk_ids"], filled(i))), F.lit(0))["number"])
        return F.array_join(F.transform(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull())), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")

    def step(a: Column, s: Column) -> Column:
        at = F.when(F.length(s["claim"]) > 0, F.call_function("instr", a["text"], s["claim"])).otherwise(0)
        marked = F.concat_ws(" ", F.regexp_replace(s["claim"], r"(?U)\s+$", ""), F.nullif(marks(s["chunk_ids"]), F.lit("")))
        text = F.concat(F.left(a["text"], at - 1), marked, F.substring(a["text"], at + F.length(s["claim"]), F.length(a["text"])))
        return F.struct(F.when(at > 0, text).otherwise(a["text"]).alias("text"), (a["lost"] | (at == 0)).alias("lost"))

    start = F.struct(F.regexp_replace("answer", r"(?U)^\s+|\s+$", "").alias("text"), F.lit(False).alias("lost"))
    rows = rows.withColumn("made", F.aggregate(line, start, step))
    shown = F.array_join(F.transform("sources", lambda c: F.concat(F.lit("["), c["number"].cast("string"), F.lit("] "), c["cite"])), "\n")
    whole = F.when(F.size("sources") > 0, F.concat(F.col("made.text"), F.lit(f"\n\n{V.BIBLIOGRAPHY}\n"), shown)).otherwise(F.col("made.text"))
    rule = F.when(F.col("strange"), "chunk_not_in_evidence").when(F.col("made.lost"), "claim_not_in_answer")
    return rows.select("answer_id", F.when(rule.isNull(), whole).alias("answer"), rule.alias("rule"))


def cards(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, number, card): sources as escaped HTML with the passages behind them."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    rows = cited.select("answer_id", "number", "cite", "chunk_ids", F.posexplode_outer("chunk_ids").alias("at", "chunk_id")).join(evidence.select("answer_id", "chunk_id", "text").dropDuplicates(["answer_id", "chunk_id"]), ["answer_id", "chunk_id"], "left")
    shown = F.when(F.col("text").isNotNull(), F.concat(F.lit("<p>"), esc(F.col("text")), F.lit("</p>")))
    quotes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(shown.isNotNull(), F.struct("at", shown.alias("p"))))), lambda r: r["p"]), "")
    card = F.concat(F.lit('<article class="source-card"><b>NGUỒN ['), F.col("number").cast("string"), F.lit("]</b><p>"), esc(F.col("cite")), F.lit("</p><details><summary>Xem evidence</summary>"), F.col("quotes"), F.lit("<small>Chunk: "), esc(F.array_join("chunk_ids", ", ")), F.lit("</small></details></article>"))
    return rows.groupBy("answer_id", "number", "cite", "chunk_ids").agg(quotes.alias("quotes")).select("answer_id", "number", card.alias("card"))
