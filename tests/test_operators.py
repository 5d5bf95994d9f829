"""Operators on small relations with results worked out by hand or in plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from evidence_engine import prompts
from evidence_engine.functions import intents, speech, text
from evidence_engine.functions import vocabulary as V
from evidence_engine.operators import citations, cleaning, comparison, dense, evidence, fusion, lexical, structure
from evidence_engine.plans import legal
from evidence_engine.sources.tables import chunk_violations


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_line_form(spark):
    assert one(spark, " a\u00a0\t b \r\n c\u200bd ", text.line_form) == "a b\n\ncd"
    assert one(spark, "e\u0301", text.nfc) == "é"


def test_tokens(spark):
    assert one(spark, "Luật 31-2024-QH15, Điều 5a: ½ ĐẤT_đai x²", text.tokens) == ["luật", "31/2024/qh15", "điều", "5a", "½", "đất", "đai", "x²"]
    assert one(spark, None, text.tokens) == []


def test_worked_numbers(spark):
    row = spark.range(1).select(lexical.idf(F.lit(2), F.lit(1)), lexical.idf(F.lit(2), F.lit(2))).first()
    assert row[0] == pytest.approx(math.log(2)) and row[1] == pytest.approx(math.log(1.2))
    hit = "query_id int, chunk_id string, rank int, score double"
    rows = {r["chunk_id"]: r for r in fusion.fused(spark.createDataFrame([(1, "a", 1, 3.0), (1, "b", 2, 2.0)], hit), spark.createDataFrame([(1, "b", 1, 0.9), (1, "c", 2, 0.8)], hit)).collect()}
    assert rows["a"]["rrf_score"] == pytest.approx(1 / 61) and rows["b"]["rrf_score"] == pytest.approx(1 / 61 + 1 / 62) and rows["c"]["bm25_score"] is None


def test_bm25_is_the_formula(spark):
    r = random.Random(3)
    docs = [(str(k), " ".join(r.choice("abcdefg") for _ in range(r.randint(0, 30)))) for k in range(40)]
    chunks = spark.createDataFrame(docs, "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "a b b zz"), (2, "g")], "query_id int, query string")
    for parts in (1, 7):
        rows = lexical.scores(lexical.term_frequencies(chunks.repartition(parts)), lexical.corpus_stats(lexical.lengths(chunks)), asked).collect()
        sizes = {c: len(t.split()) for c, t in docs}
        mean = sum(sizes.values()) / len(docs)
        for row in rows:
            words = dict(docs)[row["chunk_id"]].split()
            expected = 0.0
            for w in {1: {"a", "b", "zz"}, 2: {"g"}}[row["query_id"]]:
                df, tf = sum(w in t.split() for _, t in docs), words.count(w)
                expected += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean)) if tf else 0
            assert row["bm25_score"] == pytest.approx(expected, abs=1e-6)
        assert {(x["query_id"], x["chunk_id"]) for x in rows} == {(q, c) for c, t in docs for q, ws in ((1, "ab"), (2, "g")) if set(ws) & set(t.split())}


def test_boost_of_all_references(spark):
    asked = spark.createDataFrame([(1, "Điều 12 khoản 3 điểm a luật 31/2024/QH15")], "query_id int, query string")
    meta = spark.createDataFrame([("x", "31-2024-QH15", "Điều 12", "Khoản 3", None), ("y", "31-2024-QH15", "điều 12", "khoản 3", "Điểm a"), ("z", None, None, None, None)], "chunk_id string, document_id string, article string, clause string, point string")
    found = {r["chunk_id"]: r["metadata_boost"] for r in lexical.boosted(lexical.with_references(asked), meta).collect()}
    assert found == {"x": 20.0, "y": 23.0}
    rows = lexical.search(spark.createDataFrame([], "chunk_id string, term string, tf long, dl long"), spark.createDataFrame([(0, 0.0)], "n long, avgdl double"), lexical.with_references(asked), meta, 1).collect()
    assert [(r["chunk_id"], r["score"]) for r in rows] == [("y", 23.0)]
    with pytest.raises(ValueError):
        lexical.ranked(asked, -1)


def hybrid(spark, rows, question):
    df = spark.createDataFrame([(1, question, c, y, r, b, 0) for c, y, r, b in rows], "query_id int, query string, chunk_id string, year string, rrf_score double, bm25_score double, exact_match_count int")
    return fusion.version_boosted(df.withColumns({"document_id": F.lit(""), "document_title": F.lit("")}))


def test_version_boost_and_quota(spark):
    rows = [("old", "2013", 0.030, 1.0), ("new", "2024", 0.029, 1.0), ("later", "2025", 0.028, 1.0)]
    found = {r["chunk_id"]: r["final_score"] for r in hybrid(spark, rows, "quyền").collect()}
    assert found == {"old": 0.030, "new": 0.034, "later": 0.028}
    crowd = [(f"n{k}", "2024", 0.9 - k / 100, 1.0) for k in range(8)] + [("old", "2013", 0.1, None), ("none", None, 0.95, 1.0)]
    best = fusion.final_ranked(hybrid(spark, crowd, "so sánh"), 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in best] == ["none", "n0", "old"]
    assert [r["chunk_id"] for r in fusion.final_ranked(hybrid(spark, crowd, "so sánh"), 1).collect()] == ["none"]
    assert [r["chunk_id"] for r in fusion.final_ranked(hybrid(spark, crowd, "quyền"), 3).orderBy("rank").collect()] == ["none", "n0", "n1"]


def test_three_routers_disagree(spark):
    q = F.col("x")
    rows = {"thay đổi mục đích": ("current_default", "comparison", "comparison"), "trước đây và hiện nay": ("current_default", "current", "comparison"), "2013, 2024": ("comparison", "2013", "comparison"), "luật 2013": ("explicit", "2013", "qa")}
    df = spark.createDataFrame([(k,) for k in rows], "x string").select("x", intents.fusion_intent(q), intents.prompt_intent(q), intents.route_intent(q))
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == rows


def test_dense_search(spark):
    r = random.Random(1)
    vectors = [(k, [r.choice([0.0, 0.5, -1.0, 1.0]) for _ in range(4)]) for k in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    found = [(x["query_id"], x["rank"], x["vec_id"]) for x in dense.search(df, df.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding"), 7, block=2).collect()]
    expected = []
    for q, x in vectors[:5]:
        order = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), v) for v, y in vectors)
        expected += [(q, k, v) for k, (_, v) in enumerate(order[:7], 1)]
    assert sorted(found) == expected
    bad = spark.createDataFrame([(1, None), (2, [1.0]), (3, [1.0, float("nan")]), (4, [1.0, None]), (5, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert {(x["vec_id"], x["rule"]) for x in dense.violations(bad, 2).collect()} == {(1, "null"), (2, "dimension"), (3, "value"), (4, "value")}
    with pytest.raises(ValueError):
        dense.search(df, df, 0)


def test_split_keeps_everything():
    r = random.Random(5)
    for _ in range(300):
        t = "".join(r.choice("ab. ;c") for _ in range(r.randint(0, 200))).strip()
        most = r.randint(3, 40)
        pieces = structure.pieces_of(t, most)
        assert all(len(p) <= most for p in pieces) and re.sub(r"\s", "", "".join(pieces)) == re.sub(r"\s", "", t)
    assert structure.pieces_of("", 5) == [""] and structure.pieces_of("abc", 5) == ["abc"]


def test_chunks_are_citable(spark):
    facts = structure.parse(legal.law_lines(spark))
    made = structure.chunks(facts)
    rows = {(r["document_id"], r["article"], r["clause"], r["point"]): r for r in made.collect()}
    assert rows["31-2024-QH15", "Điều 1", "Khoản 1", "Điểm a"]["content"] == "Mở đầu của điều.\n1. Khoản một gồm:\na) điểm a của khoản một;\ntiếp theo điểm a"
    assert rows["31-2024-QH15", "Điều 1", "Khoản 1", None]["content"] == "Mở đầu của điều.\n1. Khoản một gồm:"
    assert "1. không phải khoản" in rows["31-2024-QH15", "Điều 1", "Khoản 1", "Điểm đ"]["content"]
    assert rows["31-2024-QH15", "Điều 2", None, None]["content"].endswith("a) điểm mồ côi")
    assert rows["31-2024-QH15", "Điều 3", "Khoản 1", None]["section"] == "Mục 2 - TIÊU ĐỀ CÙNG DÒNG" and rows["31-2024-QH15", "Điều 4", None, None]["chapter"] == "Chương II"
    small = structure.chunks(facts, 65)
    ids = [r["chunk_id"] for r in small.collect()]
    assert len(ids) == len(set(ids)) and sorted(ids) == sorted(r["chunk_id"] for r in structure.chunks(structure.parse(legal.law_lines(spark).repartition(5)), 65).collect())
    rules = {(r["document_id"], r["rule"]) for r in structure.warnings(facts, made, legal.law_lines(spark)).collect()}
    assert rules == {("31-2024-QH15", "point_without_clause"), ("45-2013-QH13", "section_without_chapter"), ("45-2013-QH13", "duplicate_article"), ("45-2013-QH13", "duplicate_clause")}


def test_a_point_with_an_open_quote_does_not_start_a_quotation():
    lines = ["Điều 1. A", "1. x", "a) “mở", "2. y", "thêm “trích", "3. trong trích", "đóng”", "4. z", "Luật này được Quốc hội thông qua", "Điều 9. sau"]
    kinds = [r[1] for r in structure.Reader(lines).rows()]
    assert kinds == ["article", "clause", "point", "clause", "text", "text", "text", "clause", "postamble", "postamble"]


def test_expansion(spark):
    names = "chunk_id string, chunk_pos long, document_id string, article string, text string"
    corpus = spark.createDataFrame([(f"c{k}", k, "D", "A" if k < 6 else "B", "w " * n) for k, n in enumerate([5, 40, 70, 20, 50, 10, 5, 5])], names)
    hits = spark.createDataFrame([(1, 1, "c0"), (1, 2, "c6"), (1, 3, "c5"), (1, 4, "c0")], "query_id int, pos int, chunk_id string").join(corpus.drop("chunk_pos"), "chunk_id")
    got = evidence.expanded(hits, corpus, 100, F.size(F.split(F.trim("text"), " ")).cast("long")).orderBy("evidence_pos").collect()
    # 20 words are used; nearest first c1 (40), c4 (50: too much), c2 (70: too much), c3 (20)
    assert [(r["chunk_id"], r["expanded"]) for r in got] == [("c0", False), ("c1", True), ("c3", True), ("c5", False), ("c6", False)]
    with pytest.raises(ValueError):
        evidence.packed(hits, 0)


def test_packing_stops_where_admission_skips(spark):
    rows = spark.createDataFrame([(1, k, "w " * n) for k, n in enumerate([40, 70, 20, 50, 10], 1)] + [(2, 1, "a b c d"), (2, 2, "e")], "query_id int, evidence_pos int, block string")
    assert [(r["query_id"], r["evidence_pos"], r["tokens"]) for r in evidence.packed(rows, 100).collect()] == [(1, 1, 40), (2, 1, 4), (2, 2, 1)]
    assert [(r["evidence_pos"], r["block"]) for r in evidence.packed(rows.where("query_id = 2"), 3).collect()] == [(1, "a b c")]
    lines = spark.createDataFrame([(1, 1, "a\n b  c\nd e")], "query_id int, evidence_pos int, block string")
    assert evidence.packed(lines, 4).first()["block"] == "a\n b  c\nd"
    assert tuple(evidence.packed(lines, 4, evidence.CHARACTERS).first())[2:] == ("a\n b", 4)
    model = evidence.tokens_of(lambda texts: [list(map(ord, t)) for t in texts], lambda ids: ["".join(map(chr, i)) for i in ids])
    assert tuple(evidence.packed(lines, 4, model).first())[2:] == ("a\n b", 4)
    line = spark.createDataFrame([(1, k, n, f"c{n}") for k, n in enumerate([40, 70, 20, 50, 10], 1)], "query_id int, turn int, cost int, chunk_id string")
    assert {r["chunk_id"] for r in evidence.admitted(spark.createDataFrame([], "query_id int, cost int"), line, 100).collect()} == {"c40", "c20", "c10"}


def test_tags(spark):
    assert one(spark, "a [Nguồn 1, nguồn 2,Nguồn  3] b, c [Nguồn 4] [x, y]", citations.ungrouped) == "a [Nguồn 1] [Nguồn 2] [Nguồn 3] b, c [Nguồn 4] [x, y]"
    rows = {r["line_no"]: (r["claim"], list(r["chunk_ids"]), list(r["cited"])) for r in citations.tagged(legal.answers(spark).where("answer_id = 1"), legal.evidence(spark)).collect()}
    assert rows == {1: ("Ý một  .", ["c2", "c1"], [2, 1]), 2: ("Ý hai", ["c3"], [1]), 5: ("Ý ba", ["c1", "c2"], [1, 2])}
    loose = {r["rule"] for r in citations.violations(legal.answers(spark).where("answer_id = 2"), legal.evidence(spark), strict=False).collect()}
    assert loose == {"tags_without_claim", "tag_not_in_evidence"}
    lost = citations.unknown(legal.evidence(spark), spark.createDataFrame([(1, "c1"), (1, "zz"), (1, " ")], "answer_id long, chunk_id string")).collect()
    assert [r["chunk_id"] for r in lost] == ["zz"]


def test_manual_citing(spark):
    answers = spark.createDataFrame([(1, " Ý một. Ý hai, ý một. "), (2, "Chỉ một nguồn"), (3, "x"), (4, "mất ý"), (9, "không có")], "answer_id long, answer string")
    proof = spark.createDataFrame(
        [(1, 1, "c1", "Luật A", "Điều 1"), (1, 2, "c2", "Luật A", "Điều 2"), (1, 3, "c3", "Luật A", "Điều 1"), (2, 1, "d1", "Luật B", None), (3, 1, "e1", "Luật C", None), (4, 1, "f1", "Luật D", None), (4, 2, "f2", "Luật E", None)],
        "answer_id long, evidence_pos long, chunk_id string, document_title string, article string",
    ).withColumns({c: F.lit(None).cast("string") for c in ("document_id", "clause", "point")})
    supports = spark.createDataFrame([(1, 2, "ý một", ["c2", "c3", "c1"]), (1, 1, "Ý hai ", ["c3"]), (1, 3, "Ý hai", ["c1"]), (2, 1, "nguồn", ["d1"]), (3, 1, "x", ["zz"]), (4, 1, "khác", ["f1", "f2"])], "answer_id long, nth int, claim string, chunk_ids array<string>")
    found = {r["answer_id"]: (r["answer"], r["rule"]) for r in citations.cited(answers, proof, supports.where("claim <> 'Ý hai '")).collect()}
    assert found == {
        1: (f"Ý một. Ý hai [1], ý một [2][1].\n\n{V.BIBLIOGRAPHY}\n[1] Luật A → Điều 1\n[2] Luật A → Điều 2", None),
        2: (f"Chỉ một nguồn\n\n{V.BIBLIOGRAPHY}\n[1] Luật B", None), 3: (None, "chunk_not_in_evidence"), 4: (None, "claim_not_in_answer"), 9: ("không có", None),
    }
    assert citations.cited(answers.where("answer_id = 1"), proof, supports).first()["rule"] == "claim_not_in_answer"
    chosen = spark.createDataFrame([(1, "c2")], "answer_id long, chunk_id string")
    assert citations.cited(answers.where("answer_id = 1"), proof, chosen=chosen).first()["answer"].endswith(f"{V.BIBLIOGRAPHY}\n[1] Luật A → Điều 2")
    assert citations.cited(answers.where("answer_id = 2"), proof).first()["answer"].endswith("[1] Luật B")


def test_identity(spark):
    rows = spark.createDataFrame([(1, 1, "a", None, "t"), (1, 2, None, "a", "u"), (1, 3, "", "", "t"), (1, 4, None, None, "t"), (1, 5, None, None, "v")], "query_id int, pos int, chunk_id string, metadata_chunk_id string, text string")
    assert sorted(r["pos"] for r in evidence.first_of_each(rows).collect()) == [1, 3, 5]


def test_prompts(spark):
    q, c = F.lit("Luật 2013 là gì?"), F.lit("[Nguồn 1]\nx")
    messages = spark.range(1).select(prompts.question_messages(q, c)).first()[0]
    assert [m["role"] for m in messages] == ["system", "user"] and V.NO_EVIDENCE in messages[0]["content"] and "45/2013/QH13" in messages[0]["content"] and "[Nguồn 1]" in messages[1]["content"]
    both = spark.range(1).select(prompts.comparison_messages(q, c, F.lit("[Nguồn 2]\ny"), (1, 2))).first()[0]
    assert "1. Quy định năm 2013:" in both[0]["content"] and "3. Điểm giống:" not in both[0]["content"] and "NHÃN PHÍA HIỆN HÀNH: [Nguồn 2]" in both[1]["content"]
    again = spark.range(1).select(prompts.retry_messages(prompts.question_messages(q, c), F.lit("sai"), (3, 4))).first()[0]
    assert [m["role"] for m in again] == ["system", "user", "assistant", "user"]
    for bad in (lambda: prompts.comparison_messages(q, c, c, (2, 3)), lambda: prompts.retry_messages(F.array(), q, (1, 2, 3, 4)), lambda: comparison.shifted(c, -1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="empty question"):
        spark.range(1).select(prompts.question_messages(F.lit(" "), c)).collect()
    with pytest.raises(Exception, match=V.NO_COUNTERPART[:10]):
        spark.range(1).select(prompts.comparison_messages(q, c, F.lit(""))).collect()


def test_checks_of_chunks(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), (" ", "z"), ("b", None)], "chunk_id string, text string")
    assert {(r["chunk_id"], r["rule"]) for r in chunk_violations(rows).collect()} == {("a", "repeated_id"), (" ", "blank_id"), ("b", "blank_text")}
    other = spark.createDataFrame([("a", "x", "a"), ("b", "y", "c"), ("d", "z", None)], "chunk_id string, text string, metadata_chunk_id string")
    assert {(r["chunk_id"], r["rule"]) for r in chunk_violations(other).collect()} == {("b", "other_id_in_metadata"), ("d", "other_id_in_metadata")}


def test_cleaning_against_a_loop(spark):
    r = random.Random(9)
    rows = [(d, k, r.choice(["", " ", "a", "a ", "b", "- 1 -", "trang 2"])) for d in range(5) for k in range(60)]
    found = {}
    for x in cleaning.clean_lines(spark.createDataFrame(rows, "document_id int, line_no int, text string").repartition(4)).orderBy("document_id", "line_no").collect():
        found.setdefault(x["document_id"], []).append(x["text"])
    for d in range(5):
        kept = []
        for t in (t.strip() for e, _, t in rows if e == d):
            if t and t not in ("- 1 -", "trang 2") and (not kept or kept[-1] != t):
                kept.append(t)
        assert found[d] == kept


def test_spoken_numbers():
    assert len(speech.NUMBERS) == 9 + 9 * 11 + 8 and speech.NUMBERS["chín mươi chín"] == 99 and speech.NUMBERS["hai mươi mốt"] == 21 and "mười mốt" not in speech.NUMBERS


def test_composition_is_unicodes(spark):
    import random
    import unicodedata

    r = random.Random(4)
    texts = [None, "", "\u0110i\u1ec1u ki\u1ec7n", "e\u0302\u0323 e\u0323\u0302 \u212b \u212a", "\u0958 \u2adc \uf900"]
    letters = [c for c in map(chr, range(0xC0, 0x1F00)) if unicodedata.normalize("NFC", c) == c and unicodedata.decomposition(c) and not unicodedata.decomposition(c).startswith("<")]
    texts += ["".join(unicodedata.normalize("NFD", r.choice(letters)) + r.choice(["", " ", "a"]) for _ in range(30)) for _ in range(200)]
    texts += ["".join(r.choice("aeouAEOUđ") + "".join(r.sample("̛̣̂̆́̀̉̃", r.randint(0, 1))) for _ in range(20)) for _ in range(200)]
    found = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", text.nfc(text.F.col("t")).alias("n")).collect()
    for row in found:
        t = texts[row["id"]]
        assert row["n"] == (None if t is None else unicodedata.normalize("NFC", t))


def test_decomposed_questions_are_as_good(spark):
    import unicodedata

    question = "Điều 27: quyền chuyển nhượng đất"
    rows = spark.createDataFrame([(1, question), (2, unicodedata.normalize("NFD", question))], "query_id long, query string")
    a, b = (r["t"] for r in rows.select(text.tokens(text.F.col("query")).alias("t")).collect())
    assert a == b and "chuyển" in a
    assert len({r["article"] for r in rows.select(text.references(text.F.col("query"))["article"].alias("article")).collect()}) == 1
