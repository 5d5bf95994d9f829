"""The n-gram Jaccard join and components against plain Python."""

import random

from evidence_engine.llm import components, jaccard_join


def plain(rows, n=4, percent=85):
    sets = []
    for _, text in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
        words = [w for w in words if w]
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted(((d, len(sets[k]), least.get(find(k)) if sets[k] else d) for k, (d, _) in enumerate(rows)), key=str)


def check(spark, rows, **options):
    df = spark.createDataFrame([(d, t, b"k", 1) for d, t in rows], "doc_id long, text string, key binary, n int")
    found = sorted((tuple(r) for r in jaccard_join.linked(df, **options).collect()), key=str)
    assert found == plain(rows, options.get("n", 4), options.get("percent", 85))


def test_edge_cases(spark):
    check(spark, [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\ttwo"), (8, "a b c d"), (9, "É b c d"), (10, "é b c d"), (11, "a b c d a b c d"), (12, "a b c d"), (12, "a b c d"), (13, "x " * 30000), (14, "x " * 5000), (None, "one")])
    assert jaccard_join.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def edited(r, words, share, vocabulary):
    return [r.choice(vocabulary) if r.random() < share else w for w in words]


def test_near_copies(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(3000)]
    rows, passage = [], [r.choice(vocabulary) for _ in range(60)]
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(5, 300))]
        rows += [" ".join(edited(r, base, r.choice([0, 0.002, 0.01, 0.02, 0.03, 0.05]), vocabulary)) for _ in range(r.randint(1, 25))]
    rows += [" ".join(passage + [r.choice(vocabulary) for _ in range(r.randint(0, 12))]) for _ in range(60)]
    rows += [" ".join([r.choice(vocabulary) for _ in range(200)] + passage) for _ in range(20)]
    r.shuffle(rows)
    rows = [(k * 3, t) for k, t in enumerate(rows)]
    check(spark, rows)
    check(spark, rows, n=2, percent=60)


def test_one_of_each(spark):
    df = spark.createDataFrame([(5, "a b c d e", "x"), (3, "a b c d e", "y"), (3, "a b c d e", "y"), (9, None, "z"), (10, "other words in here", None)], "doc_id long, text string, key string")
    assert sorted(tuple(r) for r in jaccard_join.one_of_each(df).collect()) == [(3, "a b c d e", "y"), (9, None, "z"), (10, "other words in here", None)]


def test_one_of_each_without_or_with_the_same_id(spark):
    text, own, lone = "a b c d e", "a text of its own here", "like no other one at all"
    rows = [(3, text), (7, text), (7, own), (None, lone), (None, text), (None, "p q r s"), (None, "p q r s"), (None, None), (8, "lone pair of words"), (8, "LONE pair of words")]
    found = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    plain = [tuple(r) for r in found if r["doc_id"] != 8]
    assert sorted(plain, key=str) == sorted([(3, text), (7, own), (None, lone), (None, "p q r s"), (None, None)], key=str)
    assert sum(r["doc_id"] == 8 for r in found) == 1


def test_components_of_chains(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(r.randint(200, 230), r.randint(200, 230)) for _ in range(25)] + [(7, 7)]
    root = {k: k for e in edges for k in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {k for a, b in edges if a != b for k in (a, b)}
    found = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: v for k, v in root.items() if k in linked}
