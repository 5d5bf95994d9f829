"""Removal of repeated substrings against plain Python, and its merge against sorting."""

import random
from hashlib import sha256

from evidence_engine.llm import suffix_dedup as D


def plain(rows, length=100):
    """rows in order of (doc_id, ...)."""
    seen, out = set(), []
    for doc_id, text in rows:
        raw = (text or "").encode()
        mask = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                mask[i : i + length] = b"\1" * length
            seen.add(w)
        spans = sum(mask[i] and (i == 0 or not mask[i - 1]) for i in range(len(mask)))
        kept = bytes(b for b, m in zip(raw, mask, strict=True) if not m)
        out.append((doc_id, len(raw), sum(mask), spans, sha256(kept).hexdigest()))
    return out


def check(spark, rows, length=100, partitions=5, **options):
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, kept string").repartition(partitions)
    found = sorted((tuple(r)[:5] for r in D.spans(df, length, **options).collect()), key=str)
    assert found == sorted(plain(sorted(rows, key=lambda r: -1 if r[0] is None else r[0]), length), key=str)


def test_edge_cases(spark):
    x = "".join(chr(97 + k * k % 26) for k in range(100))
    check(spark, [(1, None), (2, ""), (3, "short"), (4, x), (5, x), (6, x[:99]), (7, x + "!"), (8, "?" + x), (9, x[1:]), (10, "é" * 150), (11, "a" * 5000), (12, "ab" * 2000), (13, x * 7), (14, "a" * 99), (15, x + x[::-1] + x), (16, "😀" * 400), (17, "\x00" * 300), (17, "\x00" * 300), (None, x)])
    assert D.spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_random_repeats(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("etaoin shrdlu") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(r.randint(10, 60)) for _ in range(12)]
    rows = []
    for k in range(260):
        t = text(r.randint(1, 60))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            t += p[a : a + r.randint(60, 300)] + r.choice(["", " ", text(4)])
        if rows and r.random() < 0.25:
            copy = r.choice(rows)[1]
            at = r.randint(0, len(copy))
            t = copy[:at] + r.choice(["", "x", text(3)]) + copy[at + r.randint(0, 3) :]
        rows.append((k * 7 % 1009, t))
    check(spark, rows)
    check(spark, rows, length=40, partitions=3)
    # every gram counts as hot: windows go by classes
    check(spark, rows, partitions=4, hot=1)
    check(spark, rows, length=40, hot=3)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)
    check(spark, rows, hot=2)


def test_a_hot_phrase_spreads_over_all_ranges(spark):
    """A phrase that all texts share, with other bytes around it: as a gram it is one range's, by classes it isn't."""
    import numpy as np

    r = random.Random(8)
    noise = lambda n: "".join(r.choice("etaoinshrdlu ") for _ in range(n))
    phrase = "the very same forty bytes or so of words "
    rows = [(k, noise(150) + phrase + noise(150)) for k in range(300)]
    raw, at = "".join(t for _, t in rows).encode(), np.arange(300) * (300 + len(phrase)) + 150
    keys = np.concatenate([k for k, *_ in D.in_classes(raw, at, at - 80, at, 100, 16)])
    assert len(np.unique(keys)) == len(keys) > 8 * 300 * 0.8
    check(spark, [*rows, *rows[:3]], hot=5)


def test_loser_tree_is_a_sort():
    r = random.Random(2)
    for n in (0, 1, 2, 3, 7, 300):
        lists = [sorted("".join(r.choice("ab") for _ in range(r.randint(0, 12))).encode() for _ in range(r.randint(0, 30))) for _ in range(n)]
        runs, label = [], 0
        for strings in lists:
            runs.append((D.front_coded(strings)[0], strings, list(range(label, label + len(strings)))))
            label += len(strings)
        every = [s for strings in lists for s in strings]
        if not n:
            continue
        shared, strings, labels = D.merged(runs)
        assert strings == sorted(every) and [every[k] for k in labels] == strings and sorted(labels) == list(range(len(every)))
        assert all(c == D.mismatch(a, b, 0) for a, b, c in zip(strings, strings[1:], shared[1:], strict=False))
