"""Quality statistics and rules, and the pipeline's stages, against plain Python."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from evidence_engine.llm import queries, quality
from test_llm_plain import base, components_of, plain_mix

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def counts(t):
    w = words(t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    r = random.Random(4)
    texts = [None, "", " \n\n", "a b c d e a b c d e", "x " * 5000, "é b\x1cc 😀 #*$%&|<>", "same\nsame\n same\n\nsame"] + [" ".join(r.choice("abc") for _ in range(r.randint(0, 40))).replace("a b", "a\nb") for _ in range(200)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(0, "twice", 1), (None, "no id", 1)], "doc_id long, text string, n_words int")
    for r in quality.statistics(df).collect():
        if r["doc_id"]:
            assert tuple(r)[1:6] == counts(texts[r["doc_id"]]), texts[r["doc_id"]]
    assert quality.statistics(df).count() == len(texts) + 2 and quality.statistics(df.limit(0)).count() == 0


def test_rules_without_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    for r in quality.judged(docs, none).collect():
        assert r["kept"] == (not r["base_failed"]) == (r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"])


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 2 = 0")
    found = quality.judged(docs.select("doc_id", "text"), seen).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in found) / len(found)
    clean = [r["kept"] for r in found if r["quality"] == 1]
    assert right > 0.97 and sum(clean) / len(clean) > 0.99


def test_kept_is_the_list_in_plain_python(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.written(quality.statistics(docs), "quality")
    rules = quality.learn(stats, labels).rules
    counted = {r["doc_id"]: r.asDict() for r in stats.collect()}
    assert rules and len(counted) == docs.count()

    def kept(r):
        if r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]:
            return False
        value = {k: float(r[a]) if b is None else r[a] / max(1, r[b]) for k, (a, b) in quality.RATIOS.items()}
        return not any(all(value[k] >= v if sign == ">=" else value[k] <= v for k, sign, v in rule) for rule in rules)

    found = {r["doc_id"]: r["kept"] for r in quality.judged(docs, labels).collect()}
    assert found == {k: kept(r) for k, r in counted.items()} and not all(found.values())


def test_grow_finds_a_threshold():
    r = np.random.default_rng(1)
    x = {"a": r.random(900), "b": r.random(900)}
    rules = quality.grow(x, (x["a"] > 0.7) & (x["b"] < 0.5)).rules
    assert rules and {k for k, _, _ in rules[0]} == {"a", "b"}
    assert quality.grow(x, np.zeros(900, bool)).rules == [] and quality.grow({k: v[:0] for k, v in x.items()}, np.zeros(0, bool)).rules == []


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    key = lambda rows, columns: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[columns.index(c)] for c in sorted(names))) for r in rows)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names) and key([tuple(r) for r in df.collect()], df.columns) == key(found.fetchall(), names)


def test_pipeline(spark):
    rows, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows["documents"] = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        docs = queries.token_files.written(out, f"test-{k}")
        rows[name] = docs.collect()
        assert k == 4 or docs.columns == columns
    # quality: what is kept passes the base rule, and all good documents that do are kept
    kept = {r["doc_id"] for r in rows["quality rules"]}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    for r in rows["documents"]:
        n, _, _, _, repeats = counts(r["text"])
        fits = n >= 10 and 100 * repeats <= 20 * n
        assert fits or r["doc_id"] not in kept
        assert not fits or r["doc_id"] not in good or r["doc_id"] in kept
    # near duplicates: the smallest of each component
    least = {min(c) for c in components_of({r["doc_id"]: r["text"] for r in rows["quality rules"]}, 5, 80)}
    assert {r["doc_id"] for r in rows["near duplicates"]} == least
    # personal data: nothing that the fixed patterns find is left, other texts are as they were
    before = {r["doc_id"]: r["text"] for r in rows["near duplicates"]}
    for r in rows["personal data"]:
        assert not base(r["text"]) and r["n_chars"] == len(r["text"])
        assert base(before[r["doc_id"]]) or r["text"] == before[r["doc_id"]] or re.search("<(EMAIL|IP|CARD|PHONE|SECRET)>", r["text"])
    # mix: each source's words are its target
    sizes, target = plain_mix([(r["doc_id"], r["source"], len(words(r["text"]))) for r in rows["personal data"]])
    took = defaultdict(int)
    for r in rows["source mix"]:
        took[r["source"]] += len(words(r["text"]))
    assert {s: n for s, n in took.items() if n} == {s: round(t) for s, t in target.items() if round(t)}
    # ids: as the library has them
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_file())
    library.no_truncation()
    library.no_padding()
    assert len(rows["token ids"]) == len(rows["source mix"])
    for r in rows["token ids"]:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline_on_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
