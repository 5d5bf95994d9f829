"""From DOCX files to cited answers, with stand-ins for models."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from evidence_engine import __main__ as cli
from evidence_engine import config, engine, voice
from evidence_engine.functions import vocabulary as V
from evidence_engine.operators import structure
from evidence_engine.sources import docx, files, tables
from evidence_engine.streaming.ingest import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
LAWS = {
    "luat-45-2013-QH13": ["Chương I", "QUY ĐỊNH CHUNG", "Điều 5. Quyền của người sử dụng đất", "1. Người sử dụng đất được cấp giấy chứng nhận năm cũ.", "2. Được hưởng thành quả lao động.", "a) trên đất;", "b) dưới đất."],
    "luat-31-2024-QH15": ["Chương I", "QUY ĐỊNH CHUNG", "Điều 26. Quyền của người sử dụng đất", "1. Người sử dụng đất được cấp giấy chứng nhận hiện nay.", "2. Được hưởng thành quả lao động mới.", "Điều 27. Nghĩa vụ", "Nộp thuế đầy đủ."],
}


def write_docx(path, lines, header=None):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = "<w:tbl><w:tr>" + "".join(f"<w:tc>{p(t)}</w:tc>" for t in ("ô  một", "ô một", "", "ô hai")) + "</w:tr></w:tbl>"
    ref = '<w:sectPr><w:headerReference r:id="h1"/><w:footerReference r:id="h1"/></w:sectPr>' if header else ""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(map(p, lines))}{row}{ref}</w:body></w:document>")
        if header:
            z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="h1" Target="header1.xml"/></Relationships>')
            z.writestr("word/header1.xml", f"<w:hdr {W}>{p(header)}{p(header)}</w:hdr>")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("laws")
    for name, lines in LAWS.items():
        write_docx(root / f"{name}.docx", [*lines[:2], "- 3 -", "", *lines[2:], lines[-1]], "đầu trang")
    return root


@pytest.fixture(scope="module")
def built(spark, folder):
    out = folder / "out"
    cli.main(["clean", str(folder), str(out)])
    cli.main(["parse", str(out), str(out)])
    return out


def encode(texts):
    out = []
    for t in texts:
        v = [0.0] * 16
        for w in t.lower().split():
            v[sum(map(ord, w)) % 16] += 1
        out.append(v)
    return out


def chunks(spark, built):
    return spark.read.parquet(f"{built}/chunks").withColumn("year", F.lit(None).cast("string"))


def test_docx_blocks_and_cleaning(spark, folder, built):
    blocks = docx.read(spark, str(folder)).where("document_id like '%2013%'").orderBy("block_no").collect()
    assert [b["kind"] for b in blocks][-3:] == ["table_row", "header_footer", "header_footer"] and blocks[-3]["cells"] == ["ô  một", "ô một", "", "ô hai"]
    stats = {r["document_id"]: r for r in spark.read.parquet(f"{built}/manifest").collect()}["luat-45-2013-QH13"]
    assert (stats["page_number_lines_removed"], stats["empty_lines_removed"], stats["duplicate_lines_removed"], stats["header_footer_lines_excluded"], stats["removed_line_count"]) == (1, 1, 1, 2, 5)
    log = {(r["reason"], r["text"], r["count"]) for r in spark.read.parquet(f"{built}/removal_log").where("document_id like '%2013%'").collect()}
    assert log == {("page_number", "- 3 -", None), ("consecutive_duplicate", "b) dưới đất.", None), ("header_footer", "đầu trang", 2)}
    text = [r["text"] for r in spark.read.parquet(f"{built}/lines").where("document_id like '%2013%'").orderBy("line_no").collect()]
    assert text == [*LAWS["luat-45-2013-QH13"], "ô một | ô hai"]
    with pytest.raises(FileNotFoundError):
        docx.read(spark, str(folder / "out")).count()


def test_report_and_index(spark, built, tmp_path):
    report = {r["document_id"]: r for r in spark.read.parquet(f"{built}/report").collect()}
    assert report["45-2013-QH13"]["points"] == 2 and report["45-2013-QH13"]["warnings"] == [] and report["31-2024-QH15"]["articles"] == 2
    tables.report_gate(spark.read.parquet(f"{built}/report"))
    made = chunks(spark, built)
    facts = engine.build(made, str(tmp_path / "i"), encode)
    assert facts["chunks"] == made.count() == 7
    vectors = tables.load_dense(spark, str(tmp_path / "i/dense"), made)
    assert vectors.count() == 7
    with pytest.raises(tables.IndexError_):
        tables.load_dense(spark, str(tmp_path / "i/dense"), made.where("clause is not null"))
    with pytest.raises(tables.IndexError_):
        tables.save_lexical(made.union(made), str(tmp_path / "j"))
    with pytest.raises(tables.IndexError_):
        tables.report_gate(spark.createDataFrame([("d", ["w"])], "document_id string, warnings array<string>"))


def test_cli_build_and_query(built, tmp_path, capsys):
    cli.main(["build", str(built), str(tmp_path / "x")])
    cli.main(["query", str(tmp_path / "x"), "Điều 27 nghĩa vụ", "--top-k", "1"])
    assert "Nộp thuế" in capsys.readouterr().out


def test_cli_dense_and_hybrid(spark, built, tmp_path, capsys):
    (tmp_path / "c.yaml").write_text("bm25:\n  k1: 1.2\n  top_k: 2\nmetadata_boost:\n  article: 9.0\nembedding:\n  query_prefix: 'query: '\nretrieval:\n  top_k: 3\n  rrf_k: 50\npaths:\n  index: x/y\n")
    made = config.load(str(tmp_path / "c.yaml"))
    assert (made.lexical.k1, made.lexical.article_boost, made.lexical.top_k, made.dense.top_k, made.hybrid.rrf_k, made.paths) == (1.2, 9.0, 2, 3, 50, {"index": str(tmp_path / "x/y")})
    cli.main(["build", str(built), str(tmp_path / "x"), "--encoder", "test_engine:encode"])
    for method in ("dense", "hybrid"):
        capsys.readouterr()
        cli.main(["query", str(tmp_path / "x"), "nghĩa vụ nộp thuế đầy đủ", "Điều 26", "--method", method, "--encoder", "test_engine:encode", "--config", str(tmp_path / "c.yaml"), "--top-k", "2"])
        rows = [json.loads(line) for line in capsys.readouterr().out.strip().split("\n")]
        assert {(r["query_id"], r["rank"]) for r in rows} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    with pytest.raises(SystemExit):
        cli.main(["query", str(tmp_path / "x"), "x", "--method", "dense"])


def test_settings_without_the_package(monkeypatch):
    import sys

    text = "# x\nbm25:\n  k1: 1.5  # a\n  name: \"a: b\"\nload: true\npaths:\n  chunks: a/b.json\n"
    whole = config.parsed(text)
    monkeypatch.setitem(sys.modules, "yaml", None)
    assert config.parsed(text) == whole == {"bm25": {"k1": 1.5, "name": "a: b"}, "load": True, "paths": {"chunks": "a/b.json"}}


def test_files_for_others(spark, folder, tmp_path):
    out = str(tmp_path / "o")
    cli.main(["clean", str(folder), out, "--texts"])
    manifest = json.loads((tmp_path / "o/texts/manifest.json").read_text())
    assert [m["document_id"] for m in manifest] == sorted(LAWS, key=str.lower)
    text = (tmp_path / "o/texts/luat-45-2013-QH13.txt").read_text()
    assert text.startswith("Chương I\nQUY ĐỊNH CHUNG\n") and text.endswith("\n") and "- 3 -" not in text
    stats = json.loads((tmp_path / "o/texts/luat-45-2013-QH13.stats.json").read_text())
    assert stats["output_line_count"] == len(text.strip().split("\n"))
    # a manifest from another machine: the names beside it count
    for m in manifest:
        m["output_file"] = "/elsewhere/" + m["output_file"]
    (tmp_path / "o/texts/manifest.json").write_text(json.dumps(manifest))
    cli.main(["parse", str(tmp_path / "o/texts/manifest.json"), str(tmp_path / "p"), "--json"])
    cli.main(["parse", out, str(tmp_path / "q")])
    assert spark.read.parquet(f"{tmp_path}/p/chunks").drop("source_file").exceptAll(spark.read.parquet(f"{tmp_path}/q/chunks").drop("source_file")).isEmpty()
    chunks = json.loads((tmp_path / "p/chunks.json").read_text())
    assert len(chunks) == spark.read.parquet(f"{tmp_path}/p/chunks").count() and len(json.loads((tmp_path / "p/structured_documents.json").read_text())) == 2
    (tmp_path / "o/texts/luat-45-2013-QH13.txt").unlink()
    with pytest.raises(FileNotFoundError):
        files.read_manifest(spark, str(tmp_path / "o/texts/manifest.json"))


def good(batches):
    """A generator that follows the rules: it cites what the prompt shows."""
    import re

    out = []
    for messages in batches:
        user = messages[-1]["content"] if "EVIDENCE" in messages[-1]["content"] else messages[1]["content"]
        if "PHÍA 2013" in user:
            old, new = (re.search(p, user)[1] for p in (r"NHÃN PHÍA 2013: (\[Nguồn \d+\])", r"NHÃN PHÍA HIỆN HÀNH: (\[Nguồn \d+\])"))
            heads = V.COMPARISON_SECTIONS
            out.append(f"{heads[0]} cũ {old}\n{heads[1]} mới {new}" if "mục 1, 2" in user else f"{heads[2]} giống {old} {new}\n{heads[3]} khác {old} {new}")
        elif "[Không có" in user:
            out.append(V.NO_EVIDENCE)
        else:
            out.append("Trả lời:\nMột ý [Nguồn 1].")
    return out


def make(spark, built, tmp_path, generate):
    made = chunks(spark, built)
    engine.build(made, str(tmp_path / "e"), encode)
    return engine.load(spark, str(tmp_path / "e"), encode, generate)


def test_ask(spark, built, tmp_path):
    e = make(spark, built, tmp_path, good)
    asked = spark.createDataFrame([(1, "nghĩa vụ của người sử dụng đất"), (2, "So sánh quyền của người sử dụng đất 2013 và 2024"), (3, "Luật 2013 quyền gì")], "query_id long, query string")
    found = {r["query_id"]: r for r in e.ask(asked).collect()}
    assert found[1]["mode"] == "qa" and found[1]["rule"] is None and found[1]["answer"].startswith("Trả lời:\nMột ý . [1]") and "31/2024/QH15" in found[1]["answer"].split(V.BIBLIOGRAPHY)[1]
    assert "45/2013/QH13" in found[3]["answer"] and "31/2024" not in found[3]["answer"]
    body, sources = found[2]["answer"].split(V.BIBLIOGRAPHY)
    assert found[2]["mode"] == "comparison" and found[2]["rule"] is None
    assert [x for x in V.COMPARISON_SECTIONS if x in body] == list(V.COMPARISON_SECTIONS) and "45/2013" in sources and "31/2024" in sources


def test_unfit_answers_are_named(spark, built, tmp_path):
    e = make(spark, built, tmp_path, lambda batches: ["không nhãn" for _ in batches])
    asked = spark.createDataFrame([(1, "nghĩa vụ của người sử dụng đất"), (2, "So sánh quyền 2013 và 2024")], "query_id long, query string")
    e.retries = 1
    found = {r["query_id"]: (r["answer"], r["rule"]) for r in e.ask(asked).collect()}
    assert found[1] == (None, "claim_without_tag") and found[2][0] is None and found[2][1]


def test_voice(spark, tmp_path):
    heard = voice.transcribe(lambda p: "điều mười hai", "a.wav")
    assert heard["normalized"] == "Điều 12" and voice.transcribe(lambda p: 1 / 0, "a.wav")["warnings"] and voice.transcribe(str, None)["warnings"]
    said = voice.respond(lambda q: {"answer": "có"}, "hỏi", heard, lambda t: 1 / 0)
    assert said["rag"] == {"answer": "có"} and said["audio"] is None and said["warnings"]
    with pytest.raises(ValueError):
        voice.respond(lambda q: {"answer": " "}, "hỏi")
    with pytest.raises(ValueError):
        voice.respond(lambda q: {"answer": "x"}, "  ")


def test_synthesis_leaves_no_part(tmp_path):
    import time

    path = tmp_path / "a.mp3"
    assert voice.synthesized(lambda t, p: path.write_text(t), str(path))("có") == str(path) and path.read_text() == "có"

    def slow(text, p):
        path.write_text("part")
        time.sleep(1)

    for bad in (slow, lambda t, p: 1 / 0, lambda t, p: path.write_text("")):
        with pytest.raises(Exception):  # noqa: B017
            voice.synthesized(bad, str(path), 0.3)("x")
        assert not path.exists()


def test_audio_files(spark, tmp_path):
    import wave

    for name, frames in (("ok.wav", 8000), ("none.wav", 0)):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(b"\0" * frames)
    (tmp_path / "x.txt").write_text("x")
    found = {r["path"].rsplit("/", 1)[1]: r["rule"] for r in voice.audio_files(spark, str(tmp_path)).collect()}
    assert found == {"ok.wav": None, "none.wav": "no_samples", "x.txt": "suffix"}


def test_ingest_takes_each_file_once(spark, tmp_path):
    new = tmp_path / "in"
    new.mkdir()
    (new / "a.txt").write_text("một\n\nmột\nhai")
    for _ in range(2):
        ingest(spark, str(new), str(tmp_path / "t"), str(tmp_path / "c"))
    (new / "b.txt").write_text("ba")
    ingest(spark, str(new), str(tmp_path / "t"), str(tmp_path / "c"))
    rows = sorted((r["document_id"], r["line_no"], r["text"]) for r in spark.read.parquet(str(tmp_path / "t")).collect())
    assert rows == [("a.txt", 1, "một"), ("a.txt", 2, "hai"), ("b.txt", 1, "ba")]


def test_numerals():
    for n in range(1, 400):
        assert structure.numeral(structure.roman(n)) == n == structure.numeral(str(n))
