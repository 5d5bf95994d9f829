"""Token files, byte-pair encoding, URL filter, mixing and top-k search against plain Python."""

import math
import random
import time
import zlib
from collections import Counter, defaultdict
from hashlib import md5, sha256

import numpy as np
import pytest

from evidence_engine.llm import bpe, mixing, token_files, top_k, url_filter
from evidence_engine.llm.queries import tokenizer_file

TEXTS = [
    None, "", " ", "Hello, world's  é 12", "ΑΣ Σ İx ǅ <|endoftext|>foo<|startoftext|> it's 12½ \x1c\x1dab\x85c\u3000d e ̈x 日本語 😀👨‍👩‍👧 don't'LL",
    "a" * 3000, "\t\t\n\r\x0b", "x\x00y", "ﬁ Å Å ẞ", "same text", "same text", "word " * 4000,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    t.no_truncation()
    t.no_padding()
    return t


def docs(spark, texts=TEXTS):
    rows = [(k, t, "x", "y") for k, t in enumerate(texts)] + [(len(texts), "again", "x", "y")] * 2 + [(None, "no id", "x", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, file string")


def test_token_files(spark, library):
    df = docs(spark)
    found = sorted(token_files.tokenize(df, tokenizer_file(), docs_per_file=4).collect(), key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    expected, start = [], 0
    for doc_id, text in sorted(((r[0], r[1]) for r in df.collect()), key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in found] == expected
    assert token_files.tokenize(df.limit(0), tokenizer_file()).count() == 0


def test_one_document_is_read_alone(spark, tmp_path):
    import xxhash
    import zstandard

    writer = token_files.FileWriter(str(tmp_path / "a.zst"), 2)
    bodies = [np.arange(n, dtype="<u2").tobytes() for n in (1, 70, 3)]
    for k, b in enumerate(bodies):
        writer.add(10 + k, len(b) // 2, zstandard.compress(b), len(b), xxhash.xxh64_intdigest(b) & 0xFFFFFFFF)
    path = writer.close()[0]
    reader = token_files.FileReader(path)
    assert reader.docs == [(10, 1), (11, 70), (12, 3)] and reader.ids(1).tolist() == list(range(70))
    assert zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read() == b"".join(bodies)
    data = bytearray((tmp_path / "a.zst").read_bytes())
    data[int(reader.offsets[1]) + 12] ^= 1
    (tmp_path / "a.zst").write_bytes(data)
    with pytest.raises(Exception):  # noqa: B017
        token_files.FileReader(path).ids(1)


def test_bpe_is_the_library(spark, library):
    df = docs(spark)
    rows = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(df, tokenizer_file()).collect()}
    expected = set()
    for r in df.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        expected.add((r["doc_id"], len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows == expected
    ids = bpe.encode(df, tokenizer_file())
    assert {r[1] for r in bpe.decode(ids, tokenizer_file()).collect()} == {library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for t in [*TEXTS, "again", "no id"]}
    assert bpe.round_trip(df.limit(0), tokenizer_file()).count() == 0


def test_bpe_on_random_words(library):
    codec, r = bpe.WordCodec(tokenizer_file()), random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice("abcdeinorst'é1.😀ß ") for _ in range(r.randint(1, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://aexample.com/en/", "http://shop.net/es/1", "http://net/fr/?q", "https://a.net/en/1#x",
    "ftp://x.com", "http://x.com/?a/b#c", "http://x.com?y=/en/", "http://b.example.com/EN/", "://x.org/a?b", "http://a://b/c", "http://ÄB.org/é", "http://x.org/" + "a/" * 3000,
] * 2


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(r), r, v) for v, r in url_filter.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fit)[1:] if fit else (None, None)


def test_url_rules_and_models(spark):
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    rows = url_filter.judged(df).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path, (rule, verdict) = judge(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    assert url_filter.judged(df.limit(0)).count() == 0


def plain_models(examples, order, share):
    """What the kept contexts give: a function of (side, context, letter), and the context that is next."""
    count, kinds, total, places = Counter(), Counter(), Counter(), Counter()
    for text, good in examples:
        padded = url_filter.START * order + text
        for i in range(order, len(padded)):
            for n in range(order + 1):
                context = padded[i - n : i]
                kinds[good, context] += not count[good, context, padded[i]]
                count[good, context, padded[i]] += 1
                total[good, context] += 1
                places[context] += 1
    kept = {c for c, n in places.items() if not c or n * share >= places[""]}

    def p(good, context, letter):
        n, of = count[good, context, letter], total[good, context]
        if not context:
            return (n + 1) / (of + url_filter.A)
        q = p(good, context[1:], letter)
        return (n + kinds[good, context] * q) / (of + kinds[good, context]) if of else q

    def longest(context):
        return next(context[k:] for k in range(len(context) + 1) if context[k:] in kept)

    def score(text):
        context, out = longest(url_filter.START * order), 0.0
        for letter in text:
            out += math.log(p(1, context, letter) / p(0, context, letter))
            context = longest((context + letter)[-order:])
        return out / max(1, len(text))

    return score


@pytest.mark.parametrize(("order", "share"), [(url_filter.ORDER, url_filter.SHARE), (3, 50)])
def test_url_scores_and_verdicts_are_those_of_plain_models(spark, order, share):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    pages = pages.unionByName(spark.createDataFrame([(-1, "http://x.é/" + "ab" * 300), (-2, None), (-3, "")], "page_id long, url string"))

    def spelled(url):
        plain = "".join("0" if c in "123456789" else c for c in (url or "").lower())
        return "".join(c if c in url_filter.LETTERS else url_filter.OTHER for c in plain)

    rows = url_filter.ruled(url_filter.located(pages)).collect()
    fold = {r["page_id"]: int(md5(r["url"].encode()).hexdigest()[:8], 16) % 5 for r in rows if r["ruling"]}
    good = {r["page_id"]: int(r["ruling"] == "allow") for r in rows if r["ruling"]}
    score = plain_models([(spelled(r["url"]), good[r["page_id"]]) for r in rows if fold.get(r["page_id"])], order, share)
    scores = {r["page_id"]: score(spelled(r["url"])) for r in rows}
    held = [(max(-400, min(400, math.floor(scores[k] / 0.01))), good[k]) for k, f in fold.items() if not f]
    all_good, all_bad = sum(g for _, g in held), sum(1 - g for _, g in held)
    best = max(range(-400, 402), key=lambda c: (round(sum(1 - g for x, g in held if x < c) / all_bad - sum(g for x, g in held if x < c) / all_good, 12), -abs(c), c))
    found = {r["page_id"]: r for r in url_filter.judged(pages, order=order, share=share).collect()}
    for r in rows:
        got = found[r["page_id"]]
        assert got["score"] == pytest.approx(scores[r["page_id"]], abs=1e-9)
        assert got["verdict"] == (r["ruling"] or ("allow" if got["score"] >= best * 0.01 else "block"))


def test_long_urls_cost_their_length(spark):
    started = time.perf_counter()
    df = spark.createDataFrame([(1, "http://a.com/" + "ab/" * 350_000), (2, "http://a.net/es/" + "cd/" * 350_000), (3, "ftp://b.org/" + "ab/" * 350_000)], "page_id long, url string")
    assert len(url_filter.judged(df).collect()) == 3 and time.perf_counter() - started < 60


def plain_mix(rows):
    sizes = defaultdict(int)
    for _, source, n in rows:
        sizes[source] += n
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        for s in over or open_:
            target[s] = min(share[s], 2.0 * sizes[s])
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    return sizes, target


def test_mixing(spark):
    r = random.Random(1)
    texts = [(k, r.choice(["a", "b", "B", "é", None, "hot", "hot", "hot"]), " \n".join(["w"] * r.choice([0, 1, 3, 50, 400]))) for k in range(400)] + [(1007, "a", "twice"), (1007, "a", "twice"), (None, "b", "x y"), (900, "zero", ""), (901, None, None)]
    df = spark.createDataFrame([(i, t, s, 1) for i, s, t in texts], "doc_id long, text string, source string, size long")
    rows = mixing.taken(df).collect()
    sizes, target = plain_mix([(i, s, len((t or "").split())) for i, s, t in texts])
    assert len(rows) == len(texts)
    source = {i: s for i, s, _ in texts}
    got = defaultdict(int)
    for row in rows:
        s = source[row["doc_id"]]
        assert row["source_size"] == sizes[s] and row["target"] == pytest.approx(target[s]) and 0 <= row["taken"] <= 2 * row["size"]
        got[s] += row["taken"]
    assert dict(got) == {s: round(t) for s, t in target.items()}
    assert sorted(map(str, rows)) == sorted(map(str, mixing.taken(df.repartition(7)).collect()))
    mix = mixing.mixed(df)
    assert mix.columns == df.columns
    words = defaultdict(int)
    for row in mix.collect():
        words[row["doc_id"]] += len((row["text"] or "").split())
    by_doc = defaultdict(int)
    for row in rows:
        by_doc[row["doc_id"]] += row["taken"]
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in by_doc.items() if v}
    assert mixing.taken(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def test_mix_order_is_the_hash(spark):
    df = spark.createDataFrame([(k, "w " * 10, s) for k in range(200) for s in ["a" if k < 100 else "b"]], "doc_id long, text string, source string")
    rows = {r["doc_id"]: r for r in mixing.taken(df).collect()}
    # a weighs 3 and stops at 2000 words; b gets the other 1000: an epoch and nothing more
    assert {r["taken"] for k, r in rows.items() if k < 100} == {20} and {r["taken"] for k, r in rows.items() if k >= 100} == {10}
    key = lambda d: md5(f"17:{d}:{md5(b'w ' * 10).hexdigest()}".encode()).hexdigest()[:15]
    df = df.where("doc_id < 150")
    part = sorted((r for r in mixing.taken(df).collect() if r["doc_id"] >= 100), key=lambda r: key(r["doc_id"]))
    took = [r["taken"] for r in part]
    assert took == sorted(took, reverse=True)


def test_top_k(spark):
    r = random.Random(5)
    vectors = [[r.choice([-1, 0, 0.5, 0.251]) * 1.0 for _ in range(6)] for _ in range(300)]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(k, [0.5] * 6) for k in range(300, 420)] + [(500, None), (550, [None] * 6), (600, [float("nan")] * 6), (650, [float("inf")] * 6), (700, []), (750, [1.0, 2.0]), (751, [2.0, 2.0]), (800, [1e200] * 6), (50, vectors[50]), (None, [0.5] * 6), (51, vectors[51])]
    df = spark.createDataFrame([(*x, 3) for x in rows], "vec_id long, embedding array<double>, score int")
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = set()
    for q, x in dict(ok).items():
        if q % 50 == 0:
            found = sorted(((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(x, y, strict=True)))), c) for c, y in ok if c != q and len(y) == len(x)))
            expected |= {(q, k, c, -s) for k, (s, c) in enumerate(found[:5], 1)}
    found = [tuple(x) for x in top_k.top_k(df, top_k.F.col("vec_id") % 50 == 0, block_queries=4).collect()]
    assert set(found) == expected and len(found) == len(expected)
    assert top_k.top_k(df.limit(0), top_k.F.col("vec_id") % 50 == 0).count() == 0


def test_grouped_words_are_the_library(library):
    r, encode = random.Random(7), token_files.grouped(library, 5)
    pieces = ["", "a", "Straße", "éÉ", "µª", "x1", "don't", "日本", "ǅ", "<|endoftext|>"] + ["".join(r.choice("abcdeinorst'é1ẖक़") for _ in range(r.randint(1, 12))) for _ in range(2000)]
    assert encode(pieces) == [library.encode(p, add_special_tokens=False).ids for p in pieces] and encode([]) == []
