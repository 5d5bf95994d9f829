"""DOCX files as a table of blocks, a row for each paragraph, table row and margin line.

kind is paragraph, table_row or header_footer; text is a paragraph's, cells are a table row's. Files are
found and read through Spark's binary files, so any path that Spark opens will do.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_engine.functions.text import line_form, nfc
from evidence_engine.operators.cleaning import table_line

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
BLOCKS = "path string, document_id string, sha256 string, block_no long, kind string, text string, cells array<string>"


def paragraph_text(p) -> str:
    out = []
    for node in p.iter():
        if node.tag == W + "t":
            out.append(node.text or "")
        elif node.tag in (W + "br", W + "cr"):
            out.append("\n")
        elif node.tag == W + "tab":
            out.append("\t")
    return "".join(out)


def blocks(content: bytes):
    """(kind, text, cells) of a document's body in order, then of its headers and footers, each part once."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
        for child in body:
            if child.tag == W + "p":
                yield "paragraph", paragraph_text(child), None
            elif child.tag == W + "tbl":
                for row in child.findall(W + "tr"):
                    yield "table_row", None, [" ".join(paragraph_text(p) for p in cell.iter(W + "p")) for cell in row.findall(W + "tc")]
        names = set(z.namelist())
        targets = {}
        if "word/_rels/document.xml.rels" in names:
            for rel in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")):
                targets[rel.get("Id")] = rel.get("Target")
        seen = set()
        for ref in body.iter():
            if ref.tag in (W + "headerReference", W + "footerReference"):
                part = "word/" + str(targets.get(ref.get(R + "id"), ""))
                if part in names and part not in seen:
                    seen.add(part)
                    for p in ElementTree.fromstring(z.read(part)).iter(W + "p"):
                        yield "header_footer", paragraph_text(p), None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """BLOCKS of all *.docx files below a folder; none is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(folder)
    if files.isEmpty():
        raise FileNotFoundError(f"no .docx file in {folder}")

    def run(batches):
        import hashlib

        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                digest = hashlib.sha256(content).hexdigest()
                yield pd.DataFrame([(path, stem, digest, k, *b) for k, b in enumerate(blocks(content), 1)], columns=["path", "document_id", "sha256", "block_no", "kind", "text", "cells"])

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def lines(rows: DataFrame) -> DataFrame:
    """(document_id, line_no, text) of bodies: paragraphs by their lines, table rows as one line each."""
    text = F.when(F.col("kind") == "paragraph", line_form(nfc(F.coalesce("text", F.lit(""))))).otherwise(table_line(F.col("cells")))
    body = rows.where("kind <> 'header_footer'").select("document_id", "block_no", F.posexplode(F.split(text, "\n")).alias("at", "text"))
    from pyspark.sql import Window

    return body.select("document_id", F.row_number().over(Window.partitionBy("document_id").orderBy("block_no", "at")).cast("long").alias("line_no"), "text")


def margins(rows: DataFrame) -> DataFrame:
    """(document_id, text) of headers and footers, a row for each line with text."""
    return rows.where("kind = 'header_footer'").select("document_id", F.explode(F.split(line_form(nfc(F.coalesce("text", F.lit("")))), "\n")).alias("text")).where("text <> ''")
