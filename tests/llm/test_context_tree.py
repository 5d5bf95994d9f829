"""Unigram base and context-tree weighting against plain Python."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from evidence_engine.llm import context_tree


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [*(w for w in low.split(" ") if w), None]


def plain_model(texts, depth=2):
    """Log10-probability of a byte string by context-tree weighting over decisions, with dictionaries."""
    n = defaultdict(lambda: [0, 0])
    for raw in texts:
        padded = b"\0" * depth + raw
        for i in range(depth, len(padded)):
            for bit in range(8):
                node = (1 << bit) | padded[i] >> (8 - bit)
                for d in range(depth + 1):
                    n[node, padded[i - d : i]][padded[i] >> (7 - bit) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    longer = defaultdict(list)
    for node, context in list(n):
        if context:
            longer[node, context[1:]].append((node, context))
    memo = {}

    def weighted(key):
        if key not in memo:
            own = kt(*n[key])
            if len(key[1]) == depth:
                memo[key] = (own, 1.0)
            else:
                a, b = math.log(0.5) + own, math.log(0.5) + sum(weighted(k)[0] for k in longer[key])
                m = max(a, b) + math.log(math.exp(a - max(a, b)) + math.exp(b - max(a, b)))
                memo[key] = (m, math.exp(a - m))
        return memo[key]

    def one(node, history):
        p = 0.0
        for d in range(depth, -1, -1):
            key = (node, history[depth - d :])
            a, b = n[key] if key in n else (0, 0)
            stay = 1.0 if d == depth else weighted(key)[1] if key in n else 0.5
            p = stay * (b + 0.5) / (a + b + 1) + (1 - stay) * p
        return p

    def score(raw):
        padded, total = b"\0" * depth + raw, 0.0
        for i in range(depth, len(padded)):
            for bit in range(8):
                p = one((1 << bit) | padded[i] >> (8 - bit), padded[i - depth : i])
                total += math.log10(p if padded[i] >> (7 - bit) & 1 else 1 - p)
        return total

    return score


def check(spark, rows):
    df = spark.createDataFrame([(d, t, 2.0) for d, t in rows], "doc_id long, text string, score double")
    fold = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    counts = Counter(w for d, t in rows if not fold(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    model = plain_model([(t or "").encode() for d, t in rows if not fold(d)])
    found = context_tree.scored(df).collect()
    assert len(found) == len(rows)
    by_id = defaultdict(list)
    for d, t in rows:
        by_id[d].append(t)
    for r in found:
        t = by_id[r["doc_id"]].pop(0)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(r["doc_id"]), len(words(t)), sum(counts[w] > 0 for w in words(t)), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)))
        assert r["score"] == pytest.approx(model((t or "").encode()), rel=1e-5, abs=1e-6)


def test_scores(spark):
    r = random.Random(8)
    texts = [None, "", " ", "A b a\tB", "é😀\x00ÿ", "x" * 3000, "same", "same"] + ["".join(r.choice("abcab cde\nE") for _ in range(r.randint(0, 60))) for _ in range(40)]
    check(spark, [*enumerate(texts), (None, "null id")])


def test_nothing_to_learn_from(spark):
    out = [k for k in range(60) if context_tree.held_out(k)][:3]
    check(spark, [(k, "ab c") for k in out])
    assert context_tree.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_held_out_code_length(spark):
    """Longer contexts shorten the code of documents that were not learned."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = context_tree.scored(docs).where("held_out").selectExpr("sum(-score) * log2(10) / sum(n_bytes) bits").first()[0]
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    n = Counter(b for d, t in texts.items() if not context_tree.held_out(d) for b in t)
    total = sum(n.values())
    held = [t for d, t in texts.items() if context_tree.held_out(d)]
    plain = -sum(math.log2((n[b] + 0.5) / (total + 128)) for t in held for b in t) / sum(map(len, held))
    assert rows < 0.85 * plain


def test_query_learns_long_contexts(spark, tmp_path):
    """The query's contexts are longer than two bytes, so a passage seen in training is cheap in a held-out document."""
    from evidence_engine.llm import queries

    r = random.Random(3)
    passage = "".join(r.choice("abcd") for _ in range(400))
    texts = [None, "", "é😀\x00ÿ", "x" * 500] + [passage if k % 2 else "".join(r.choice("abcd ") for _ in range(r.randint(1, 300))) for k in range(40)]
    rows = [*enumerate(texts), (None, "null id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    fold = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    learned = [(t or "").encode() for d, t in rows if not fold(d)]
    model, short = plain_model(learned, context_tree.DEPTH), plain_model(learned)
    found = {x["doc_id"]: x["score"] for x in queries.op6_context_tree(spark, str(tmp_path)).collect()}
    assert context_tree.DEPTH > 2 and len(found) == len(rows)
    for d, t in rows:
        assert found[d] == pytest.approx(model((t or "").encode()), rel=1e-5, abs=1e-6)
    held = [d for d, t in rows if t == passage and fold(d)]
    assert held and all(found[d] > 0.2 * short(passage.encode()) for d in held)
