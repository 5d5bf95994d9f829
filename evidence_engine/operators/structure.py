"""Structure of legal documents: a fact for each line, chunks, counts and checks.

Facts are one flat table. Each line knows its kind and, by their line numbers, the chapter, section,
article, clause and point that it stands in. Everything after the parser is grouping over that table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from evidence_engine.functions import vocabulary as V

# The lines that open a part.
CHAPTER = re.compile(r"Chương\s+([IVXLCDM]+|\d+)\.?", re.I)
SECTION = re.compile(r"Mục\s+([IVXLCDM]+|\d+)\s*[.．]?\s*(.*)", re.I)
ARTICLE = re.compile(r"Điều\s+(\d+[A-Za-z]?)\s*[.．]\s*(.*)", re.I)
CLAUSE = re.compile(r"(\d+)\s*[.．]\s+(.+)")
POINT = re.compile(r"([a-zA-ZđĐ])\s*\)\s*(.+)")
CLOSING = re.compile(r"(?:Luật|Nghị quyết) này được Quốc hội\b", re.I)

FACTS = (
    "document_id string, line_no long, kind string, number string, title string, implicit boolean, "
    "chapter long, section long, article long, clause long, point long, text string"
)
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman(n: int) -> str:
    out = ""
    for value, letters in ROMAN:
        out += letters * (n // value)
        n %= value
    return out


def numeral(text: str) -> int:
    """Digits or roman letters as a number."""
    if text.isdigit():
        return int(text)
    values = [dict((letters, v) for v, letters in ROMAN)[c] for c in text.upper()]
    return sum(-v if any(w > v for w in values[k + 1 :]) else v for k, v in enumerate(values))


class Reader:
    """Reads one document's lines in order; where it stands is its whole state."""

    def __init__(self, lines: list[str]):
        self.lines = lines
        self.at = dict.fromkeys(("chapter", "section", "article", "clause", "point"))
        self.quoting = self.closed = self.implicit = False

    def enter(self, level: str, line: int) -> None:
        levels = list(self.at)
        for deeper in levels[levels.index(level) :]:
            self.at[deeper] = None
        self.at[level] = line

    def heads(self, k: int) -> bool:
        return any(p.fullmatch(self.lines[k]) for p in (CHAPTER, SECTION, ARTICLE))

    def rows(self):
        """(line_no, kind, number, title, implicit, places, text) of every line."""
        k = 0
        while k < len(self.lines):
            kind, number, title = self.line(k)
            used = k
            if kind in ("chapter", "section") and not title and k + 1 < len(self.lines) and not self.heads(k + 1):
                title, used = self.lines[k + 1], k + 1
            implicit = kind == "section" and self.implicit
            yield k + 1, kind, number, title, implicit, dict(self.at), self.lines[k]
            if used > k:
                yield k + 2, "title", None, None, False, dict(self.at), self.lines[used]
            k = used + 1

    def line(self, k: int):
        text, no = self.lines[k], k + 1
        if self.at["article"] and not self.quoting and CLOSING.match(text):
            self.closed = True
            self.enter("article", None)
        if self.closed:
            return "postamble", None, None
        if self.quoting:
            self.quoting = text.count("”") <= text.count("“")
            return self.plain()
        if m := CHAPTER.fullmatch(text):
            self.enter("chapter", no)
            self.implicit = False
            return "chapter", str(numeral(m[1])), ""
        if m := SECTION.fullmatch(text):
            self.implicit = self.implicit or self.at["chapter"] is None
            self.enter("section", no)
            return "section", str(numeral(m[1])), m[2].strip()
        if m := ARTICLE.fullmatch(text):
            self.enter("article", no)
            return "article", m[1], m[2].strip()
        if self.at["article"]:
            if m := CLAUSE.fullmatch(text):
                self.enter("clause", no)
                return "clause", m[1], None
            if m := POINT.fullmatch(text):
                self.enter("point", no)
                return "point", m[1].lower(), None
        self.quoting = text.count("“") > text.count("”")
        return self.plain()

    def plain(self):
        return ("text" if self.at["article"] else "preamble"), None, None


def parse(lines: DataFrame) -> DataFrame:
    """FACTS of a line table (document_id, line_no, text). Blank lines don't count; one document is one group."""

    def run(key, table):
        import pandas as pd

        ordered = table.sort_values("line_no")["text"].fillna("").map(str.strip)
        rows = [(key[0], no, kind, number, title, implicit, *at.values(), text) for no, kind, number, title, implicit, at, text in Reader([t for t in ordered if t]).rows()]
        out = pd.DataFrame(rows, columns=["document_id", "line_no", "kind", "number", "title", "implicit", "chapter", "section", "article", "clause", "point", "text"])
        return out.astype({c: "Int64" for c in ("chapter", "section", "article", "clause", "point")})

    return lines.select("document_id", "line_no", "text").groupBy("document_id").applyInPandas(run, FACTS)


def document_number_of(file: Column) -> Column:
    """The document number in a file name; null without one."""
    pattern = r"(?i)([0-9]+)[-/]([0-9]{4})[-/]QH([0-9]+)"
    part = lambda k: F.regexp_extract(file, pattern, k)
    return F.when(F.rlike(file, F.lit(pattern)), F.concat(part(1), F.lit("-"), part(2), F.lit("-QH"), part(3)))


def title_of(document_id: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in V.DOCUMENT_TITLES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, document_id), document_id)


def pieces_of(text: str, most: int) -> list[str]:
    """Text in pieces of at most `most` characters, cut behind a sentence or a clause, else at a space, else anywhere."""
    out = []
    while len(text) > most:
        cut = max(text.rfind(mark, 0, most) for mark in (". ", "; "))
        if cut < most // 2:
            cut = text.rfind(" ", 0, most)
        cut = most if cut <= 0 else cut + 1
        out.append(text[:cut].strip())
        text = text[cut:].strip()
    return out + [text] if text or not out else out


def split_long(text: Column, most: Column | int) -> Column:
    @pandas_udf("array<string>")
    def run(texts, limits):
        return texts.combine(limits, lambda t, n: None if t is None else pieces_of(t, int(n)))

    return run(text, F.lit(most) if isinstance(most, int) else most)


def joined(of: Column | str = "text", where: Column | None = None) -> Column:
    """Lines of a group in order, joined by line breaks."""
    row = F.struct("line_no", of)
    rows = F.array_sort(F.collect_list(row if where is None else F.when(where, row)))
    return F.array_join(F.transform(rows, lambda r: r["text"]), "\n")


def chunk_id(document_id: Column, *identity: Column) -> Column:
    parts = F.concat_ws("|", document_id, *[F.coalesce(i.cast("string"), F.lit("")) for i in identity])
    return F.concat(F.lower(document_id), F.lit("-"), F.substring(F.sha1(parts), 1, 16))


def contexts(facts: DataFrame) -> DataFrame:
    """document_id, article and the titles around it."""
    label = lambda name, number: F.concat_ws(" - ", F.concat(F.lit(name + " "), number), F.nullif("title", F.lit("")))
    as_roman = pandas_udf(lambda s: s.map(lambda n: roman(int(n))), "string")
    part = lambda kind, text: facts.where(F.col("kind") == kind).select("document_id", F.col("line_no").alias(kind), text.alias(f"{kind}_label"))
    articles = facts.where("kind = 'article'").select("document_id", "article", "chapter", "section", F.col("number").alias("article_number"), F.col("title").alias("article_title"), F.col("text").alias("heading"))
    out = articles.join(part("chapter", label("Chương", as_roman("number"))), ["document_id", "chapter"], "left")
    return out.join(part("section", label("Mục", F.col("number"))), ["document_id", "section"], "left").drop("chapter", "section")


def chunks(facts: DataFrame, max_chars: int = 3200, source_file: Column | None = None) -> DataFrame:
    """Citable chunks: whole articles without clauses, clauses without points, else a clause's lead and each point with it."""
    rows = facts.where("article is not null")
    inside = Window.partitionBy("document_id", "article")
    rows = rows.withColumn("first_clause", F.min(F.when(F.col("kind") == "clause", F.col("line_no"))).over(inside))
    bare = rows.where("first_clause is null").groupBy("document_id", "article").agg(joined().alias("content"))
    bare = bare.select("document_id", "article", F.lit(None).cast("long").alias("clause"), F.lit(None).cast("long").alias("point"), F.lit("").alias("lead"), "content", F.lit(max_chars).alias("most"))

    intro = rows.where("first_clause is not null and clause is null and point is null and kind = 'text'").groupBy("document_id", "article").agg(joined().alias("intro"))
    clauses = rows.where("clause is not null").groupBy("document_id", "article", "clause", "first_clause").agg(joined(where=F.col("point").isNull()).alias("own"), F.count(F.col("point")).alias("n_points"))
    clauses = clauses.join(intro, ["document_id", "article"], "left")
    own = F.when((F.col("clause") == F.col("first_clause")) & F.col("intro").isNotNull(), F.concat("intro", F.lit("\n"), "own")).otherwise(F.col("own"))
    clauses = clauses.withColumn("own", own)
    heads = clauses.select("document_id", "article", "clause", F.lit(None).cast("long").alias("point"), F.lit("").alias("lead"), F.when(F.col("n_points") > 0, F.regexp_replace("own", r"(?U)^\s+|\s+$", "")).otherwise(F.col("own")).alias("content"), F.lit(max_chars).alias("most"))
    points = rows.where("clause is not null and point is not null").groupBy("document_id", "article", "clause", "point").agg(joined().alias("content"))
    points = points.join(clauses.select("document_id", "article", "clause", F.regexp_replace("own", r"(?U)^\s+|\s+$", "").alias("lead")), ["document_id", "article", "clause"])
    room = F.when(F.length("content") > max_chars, max_chars - F.least(F.length("lead"), F.lit(max_chars // 3))).otherwise(F.lit(max_chars))
    points = points.select("document_id", "article", "clause", "point", "lead", "content", room.cast("int").alias("most"))

    parts = bare.unionByName(heads).unionByName(points)
    parts = parts.select("document_id", "article", "clause", "point", "lead", F.posexplode(split_long(F.col("content"), F.col("most"))).alias("piece", "content"))
    order = Window.partitionBy("document_id", "article").orderBy(F.asc_nulls_first("clause"), F.asc_nulls_first("point"), "piece")
    parts = parts.withColumn("sequence", F.row_number().over(order) - 1).withColumn("content", F.when(F.col("lead") == "", F.col("content")).otherwise(F.concat("lead", F.lit("\n"), "content")))
    numbers = lambda kind: facts.where(F.col("kind") == kind).select("document_id", F.col("line_no").alias(kind), F.col("number").alias(f"{kind}_number"))
    parts = parts.join(contexts(facts), ["document_id", "article"]).join(numbers("clause"), ["document_id", "clause"], "left").join(numbers("point"), ["document_id", "point"], "left")
    title = title_of(F.col("document_id"))
    own_heading = F.when(~F.col("content").startswith(F.col("heading")), F.col("heading"))
    text = F.concat_ws("\n", title, "chapter_label", "section_label", own_heading, "content")
    name = lambda label, number: F.concat(F.lit(label + " "), F.col(number))
    out = parts.select(
        chunk_id(F.col("document_id"), F.col("article_number"), F.col("clause_number"), F.col("point_number"), F.col("sequence"), F.col("content")).alias("chunk_id"), text.alias("text"), "content", "document_id", title.alias("document_title"),
        F.col("chapter_label").alias("chapter"), F.col("section_label").alias("section"), name("Điều", "article_number").alias("article_label"), "article_title", name("Khoản", "clause_number").alias("clause_label"), name("Điểm", "point_number").alias("point_label"),
        (source_file if source_file is not None else F.lit(None).cast("string")).alias("source_file"), F.col("article").alias("article_line"), "sequence",
    )
    position = F.row_number().over(Window.partitionBy("document_id").orderBy("article_line", "sequence")) - 1
    return out.withColumn("chunk_pos", position.cast("long")).withColumnsRenamed({"article_label": "article", "clause_label": "clause", "point_label": "point"})


def counts(facts: DataFrame) -> DataFrame:
    """chapters, sections, articles, clauses and points of every document."""
    of = lambda kind: F.count_if(F.col("kind") == kind).alias({"clause": "clauses"}.get(kind, kind + "s"))
    return facts.groupBy("document_id").agg(*map(of, ("chapter", "section", "article", "clause", "point")))


def warnings(facts: DataFrame, made: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """document_id, rule and detail of everything that a build should stop for."""
    label = F.concat(F.lit("Điều "), F.col("number"))
    branches = [
        facts.where("kind = 'section' and implicit").select("document_id", F.lit("section_without_chapter").alias("rule"), F.col("line_no").cast("string").alias("detail")),
        facts.where("kind = 'point' and clause is null").select("document_id", F.lit("point_without_clause").alias("rule"), F.col("line_no").cast("string").alias("detail")),
        facts.where("kind = 'article'").groupBy("document_id", "number").count().where("count > 1").select("document_id", F.lit("duplicate_article").alias("rule"), label.alias("detail")),
        facts.where("kind = 'clause'").groupBy("document_id", "article", "number").count().where("count > 1").select("document_id", F.lit("duplicate_clause").alias("rule"), F.concat_ws("/", F.col("article").cast("string"), "number").alias("detail")),
        facts.where("kind = 'article'").join(made.select("document_id", F.col("article_line").alias("article")).distinct(), ["document_id", "article"], "left_anti").select("document_id", F.lit("article_without_chunk").alias("rule"), label.alias("detail")),
        made.groupBy("document_id", "chunk_id").count().where("count > 1").select("document_id", F.lit("duplicate_chunk_id").alias("rule"), F.col("chunk_id").alias("detail")),
    ]
    whole = made.groupBy("document_id", F.col("article_line").alias("article")).agg(F.array_join(F.collect_list("text"), "\n").alias("all_text"))
    lost = facts.where("article is not null").join(whole, ["document_id", "article"]).where(~F.contains(F.col("all_text"), F.col("text")))
    branches.append(lost.groupBy("document_id", "article").agg(F.count(F.lit(1)).alias("n")).select("document_id", F.lit("lines_not_in_chunks").alias("rule"), F.concat_ws(":", F.col("article").cast("string"), F.col("n").cast("string")).alias("detail")))
    if lines is not None:
        full = lines.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_lines"))
        had = facts.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_facts"))
        branches.append(full.join(had, "document_id", "left").where("n_lines <> coalesce(n_facts, 0)").select("document_id", F.lit("lines_without_place").alias("rule"), (F.col("n_lines") - F.coalesce("n_facts", F.lit(0))).cast("string").alias("detail")))
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out


def report(facts: DataFrame, made: DataFrame) -> DataFrame:
    """Counts, chunks and warnings of every document."""
    n = made.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    w = warnings(facts, made).groupBy("document_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "rule", "detail"))).alias("warnings"))
    return counts(facts).join(n, "document_id", "left").join(w, "document_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0))).withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
