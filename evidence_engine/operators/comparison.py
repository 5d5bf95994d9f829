"""Two-sided comparison: focus ranking, canonical answers and what they may cite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.functions import vocabulary as V
from evidence_engine.functions.text import any_of, count_of, search_form

PLAIN = [h.split(". ", 1)[1] for h in V.COMPARISON_SECTIONS]


def requested(query: Column, phrases) -> Column:
    """Those of a list of phrases that a question has."""
    plain = search_form(query)
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(plain, p))


def keywords(query: Column) -> Column:
    """Distinct words of a question, longer than a letter and no stop words."""
    words = F.array_distinct(F.regexp_extract_all(search_form(query), F.lit("[0-9a-zà-ỹđ]+"), F.lit(0)))
    stop = F.array(*map(F.lit, V.FOCUS_STOPWORDS))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def coverage(query: Column, text: Column) -> Column:
    """The share of keywords that stand somewhere in text; 0 without keywords."""
    words = keywords(query)
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(count_of(text, words) / F.size(words))


def focus(rows: DataFrame) -> DataFrame:
    """Adds what focus ranking counts and legal_focus_score; rows have query, text and the chunk's metadata."""
    heading = search_form(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("chapter", "section", "article", "article_title", "clause", "point")]))
    rows = rows.withColumn("f_title", search_form(F.col("article_title"))).withColumn("f_heading", heading).withColumn("f_body", search_form(F.col("text")))
    everything, q = F.concat_ws(" ", "f_heading", "f_body"), F.col("query")
    intents, actions = requested(q, V.LEGAL_INTENTS), requested(q, V.LEGAL_ACTIONS)
    subjects = reduce(lambda a, b: a + b, [(F.contains(search_form(q), F.lit(s)) & any_of(everything, names)).cast("int") for s, names in V.LEGAL_SUBJECTS.items()])
    general = (F.size(actions) > 0) & F.contains(search_form(q), F.lit("điều kiện")) & any_of(F.col("f_body"), V.RIGHTS_PHRASES) & any_of(F.col("f_body"), V.CONDITION_PHRASES)
    parts = {
        "intent_title_matches": count_of(F.col("f_title"), intents), "intent_matches": count_of(everything, intents), "action_matches": count_of(everything, actions),
        "subject_matches": subjects, "general_match": general.cast("int"), "heading_coverage": coverage(q, F.col("f_heading")), "text_coverage": coverage(q, F.col("f_body")),
    }
    worth = {"general_match": 12.0, "intent_title_matches": 6.0, "action_matches": 5.0, "intent_matches": 2.0, "subject_matches": 1.5, "heading_coverage": 3.0, "text_coverage": 1.0}
    rows = rows.withColumns(parts)
    score = reduce(lambda a, b: a + b, [F.lit(w) * F.col(k) for k, w in worth.items()])
    return rows.withColumn("legal_focus_score", F.round(score, 6)).withColumns({k: F.round(k, 6) for k in ("heading_coverage", "text_coverage")}).drop("f_title", "f_heading", "f_body")


def focus_ranked(rows: DataFrame, top_k: int | None = None) -> DataFrame:
    """Adds comparison_rank within query_id and, if there is one, side: focus, then score, then place."""
    group = [c for c in ("query_id", "side") if c in rows.columns]
    score = F.coalesce(*[c for c in ("final_score", "score") if c in rows.columns], F.lit(0.0)) if {"final_score", "score"} & set(rows.columns) else F.lit(0.0)
    w = Window.partitionBy(*group).orderBy(F.desc("legal_focus_score"), F.desc(score), "pos")
    out = focus(rows).withColumn("comparison_rank", F.row_number().over(w).cast("long"))
    return out if top_k is None else out.where(F.col("comparison_rank") <= top_k)


def shifted(context: Column, offset: int) -> Column:
    """Source labels of free text, counted on from offset: pieces between labels, labels with new numbers."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    label = r"(?iU)\[Nguồn\s+([0-9]+)\]"
    numbers = F.regexp_extract_all(context, F.lit(label), F.lit(1))
    return F.array_join(F.zip_with(F.split(context, label, -1), numbers, lambda text, n: F.when(n.isNull(), text).otherwise(F.concat(text, F.lit("[Nguồn "), (n.cast("long") + offset).cast("string"), F.lit("]")))), "")


def canonical(answers: DataFrame) -> DataFrame:
    """(answer_id, answer): each section on a line of its own with its heading in full; lines before the first as they are."""
    labels = F.regexp_replace("answer", r"(?iU)\[\s*Nguồn\s+([0-9]+)\s*\]", "[Nguồn $1]")
    rows = answers.select("answer_id", F.posexplode(F.split(labels, r"\R")).alias("line_no", "raw")).withColumn("line", F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")).where("line <> ''")
    number = F.when(F.rlike("line", F.lit(r"^[1-4]\.")), F.substring("line", 1, 1).cast("int"))
    rows = rows.withColumn("number", number)
    w = Window.partitionBy("answer_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.count("number").over(w))
    rest = F.regexp_replace("line", r"(?U)^[1-4]\.\s*", "")
    full = F.element_at(F.array(*map(F.lit, V.COMPARISON_SECTIONS)), F.col("number"))
    name = F.element_at(F.array(*map(F.lit, PLAIN)), F.col("number"))
    opened = F.when(F.startswith(rest, name), F.concat(F.col("number").cast("string"), F.lit(". "), rest)).otherwise(F.rtrim(F.concat(full, F.lit(" "), rest)))
    more = F.regexp_replace("line", r"(?U)^[-*•]\s*", "")
    rows = rows.withColumn("out", F.when(F.col("number").isNotNull(), opened).when(F.col("section") > 0, more).otherwise(F.col("line")))
    # lines before the first section stand alone, later ones are folded into their section
    unit = F.when(F.col("section") > 0, F.col("section") + 1_000_000_000).otherwise(F.col("line_no").cast("long"))
    folded = rows.where("out <> ''").groupBy("answer_id", unit.alias("unit")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "out"))), lambda r: r["out"]), " ").alias("out"))
    return folded.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", "out"))), lambda r: r["out"]), "\n").alias("answer"))


def structured(answer: Column) -> Column:
    """Whether all four headings stand in order."""
    at = [F.instr(answer, h) for h in V.COMPARISON_SECTIONS]
    return reduce(lambda a, b: a & b, [p > 0 for p in at] + [a <= b for a, b in zip(at, at[1:], strict=False)])


def section_of(claim: Column) -> Column:
    return F.coalesce(*[F.when(F.startswith(claim, F.lit(h)), F.lit(k)) for k, h in enumerate(V.COMPARISON_SECTIONS, 1)])


def mapping_violations(mappings: DataFrame, sides: DataFrame) -> DataFrame:
    """(answer_id, line_no, rule): claims that cite the wrong side.

    mappings: answer_id, line_no, claim, chunk_ids; sides: answer_id, side (2013 or current), chunk_id.
    """
    pools = sides.groupBy("answer_id").agg(F.collect_set(F.when(F.col("side") == "2013", F.col("chunk_id"))).alias("old"), F.collect_set(F.when(F.col("side") == "current", F.col("chunk_id"))).alias("new"))
    empty = F.array().cast("array<string>")
    rows = mappings.join(pools, "answer_id", "left").withColumn("old", F.coalesce("old", empty)).withColumn("new", F.coalesce("new", empty)).withColumn("section", section_of(F.col("claim")))
    cited, n = F.col("chunk_ids"), F.size("chunk_ids")
    within = lambda pool: (n > 0) & (F.size(F.array_except(cited, F.col(pool))) == 0)
    rule = (
        F.when(F.col("section").isNull(), "claim_outside_sections")
        .when((F.col("section") == 1) & ~within("old"), "old_section_cites_other_side")
        .when((F.col("section") == 2) & ~within("new"), "current_section_cites_other_side")
        .when((F.col("section") >= 3) & ~(F.arrays_overlap(cited, "old") & F.arrays_overlap(cited, "new")), "shared_section_lacks_a_side")
    )
    out = rows.select("answer_id", "line_no", rule.alias("rule")).where("rule is not null")
    both = pools.where(F.arrays_overlap("old", "new")).select("answer_id", F.lit(None).cast("long").alias("line_no"), F.lit("chunk_on_both_sides").alias("rule"))
    return out.unionByName(both)
