"""Quality rules: text statistics, fixed limits and a learned decision list.

statistics() reads every text once (Arrow batches; counts over dictionary-encoded words). learn() grows
rules for bad documents by sequential covering: conjunctions of thresholds grow on two thirds of the
labelled rows by information gain, are pruned on the last third, and stand in the list if they are
precise there; what they cover is taken out and the next one grows. The list is a chain of Spark
conditions, tried in order.

Fitting sees at most `sample` labelled rows (the smallest hashes of doc_id); everything else covers all.

Defined results: null and empty texts have no words and fail the base rule; a repeated doc_id is judged
row by row; texts are counted whole, a few megabytes of them, or one longer text, at a time; without labels of both kinds the list is empty and the base rule alone decides; an empty
table gives no rows; columns beside doc_id and text are not read by judged() and are kept by accepted().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidence_engine.llm.common import written
from evidence_engine.llm.pieces import released, slices

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_pipes", "n_bangs")
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
SAMPLE = 20_000
#: What rules compare, in terms of the counts.
RATIOS = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
    "distinct": ("n_distinct", "n_words"), "upper": ("n_upper", "n_words"), "pipes": ("n_pipes", "n_words"), "bangs": ("n_bangs", "n_words"),
}


def counts(texts: list[str | None]):
    """The COUNTS of each text, as columns."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = [t or "" for t in texts]
    n = len(texts)
    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    doc = np.repeat(np.arange(n), np.diff(split.offsets.to_numpy()))
    coded = split.flatten().dictionary_encode()
    code, words = coded.indices.to_numpy(), coded.dictionary
    length = pc.utf8_length(words).to_numpy()
    keep = length[code] > 0
    code, doc = code[keep], doc[keep]
    n_words = np.bincount(doc, minlength=n)
    by_doc = lambda weight: np.bincount(doc, weights=weight, minlength=n).astype("i8")
    upper = np.asarray(pc.utf8_is_upper(words).to_numpy(zero_copy_only=False), "i8") * (length > 1)
    # windows of five words: a random odd multiplier for each place makes the key
    multiply = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "u8")
    salt = np.random.default_rng(11).integers(0, 2**63, len(words), dtype="u8")
    covered = np.zeros(len(code), bool)
    if len(code) >= 5:
        value = salt[code]
        key = reduce(np.add, (value[k : len(code) - 4 + k] * multiply[k] for k in range(5)))
        whole = np.flatnonzero(doc[4:] == doc[:-4])
        key = key[whole] ^ (doc[whole].astype("u8") * np.uint64(0xE7037ED1A0B428DB))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        starts = whole[order[again]]
        edge = np.zeros(len(code) + 5, "i8")
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + 5, -1)
        covered = np.cumsum(edge)[: len(code)] > 0
    pairs = np.unique(doc.astype("i8") << 32 | code) if len(code) else np.zeros(0, "i8")
    lines = [[x for x in t.split("\n") if x.strip(SPACE)] for t in texts]
    return [
        n_words, by_doc(length[code]), [sum(map(t.count, SYMBOLS)) for t in texts], [len(x) - len(set(x)) if len(x) > 1 else 0 for x in lines], by_doc(covered), list(map(len, lines)),
        np.bincount(pairs >> 32, minlength=n), by_doc(upper[code]), [t.count("|") for t in texts], [t.count("!") for t in texts],
    ]


def statistics(docs: DataFrame, keep_columns: bool = False) -> DataFrame:
    """The COUNTS beside doc_id, or beside all columns."""
    rows = docs.drop(*COUNTS) if keep_columns else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T.StructType([*(rows.schema.fields if keep_columns else rows.schema.fields[:1]), *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text", 6 << 20):
                kept = part.columns if keep_columns else part.columns[:1]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, pa.int64()) for c in counts(part.column("text").to_pylist())]], schema.names)
        released()

    return rows.mapInArrow(run, schema)


def ratio(name: str) -> Column:
    top, bottom = RATIOS[name]
    return F.col(top).cast("double") if bottom is None else F.col(top) / F.greatest(F.lit(1), F.col(bottom))


def base_failed(least_words: int = 10, most_repeats: int = 20) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


class DecisionList:
    """Ordered rules; a rule is a list of (ratio, sign, threshold), all of which must hold. What a rule fits is rejected."""

    def __init__(self, rules: list[list[tuple[str, str, float]]]):
        self.rules = rules

    def rejects(self) -> Column:
        """The list as one conditional expression."""
        out = None
        for rule in self.rules:
            fits = reduce(lambda a, b: a & b, [ratio(name) >= F.lit(v) if sign == ">=" else ratio(name) <= F.lit(v) for name, sign, v in rule])
            out = F.when(fits, F.lit(True)) if out is None else out.when(fits, F.lit(True))
        return F.lit(False) if out is None else out.otherwise(F.lit(False))


def grow(x: dict, bad, bins: int = 48) -> DecisionList:
    """Sequential covering over columns x (name: array) and labels bad (array of bool)."""
    import numpy as np

    n = len(bad)
    grown = np.arange(n) % 3 < 2
    edges = {k: np.unique(np.quantile(v, np.linspace(0, 1, bins))) if n else np.zeros(0) for k, v in x.items()}
    fits = lambda rule: reduce(np.logical_and, [x[k] >= v if sign == ">=" else x[k] <= v for k, sign, v in rule], np.ones(n, bool))
    left, rules = np.ones(n, bool), []
    while (left & grown & bad).sum() >= 3 and len(rules) < 20:
        rule: list[tuple[str, str, float]] = []
        while len(rule) < 4:
            inside = left & grown & fits(rule)
            p, q = (inside & bad).sum(), (inside & ~bad).sum()
            if not q:
                break
            best = None
            for k in x:
                v, good = x[k][inside], bad[inside]
                for sign in (">=", "<="):
                    for e in edges[k]:
                        hit = v >= e if sign == ">=" else v <= e
                        a = (hit & good).sum()
                        b = hit.sum() - a
                        if a < 3 or b == q:
                            continue
                        gain = a * (np.log2(a / (a + b)) - np.log2(p / (p + q)))
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, (k, sign, float(e)))
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
        # prune: the shortest head that is worth as much on rows that growing has not seen
        kept, worth = [], -2.0
        for upto in range(1, len(rule) + 1):
            hit = left & ~grown & fits(rule[:upto])
            p, q = (hit & bad).sum(), (hit & ~bad).sum()
            if p + q and (p - q) / (p + q) > worth + 1e-9:
                worth, kept = (p - q) / (p + q), rule[:upto]
        hit = fits(kept) if kept else np.zeros(n, bool)
        p, q = (left & hit & bad).sum(), (left & hit & ~bad).sum()
        if not kept or worth < 0.9 or q > 0.02 * (p + q):
            break
        rules.append(kept)
        left &= ~hit
    return DecisionList(rules)


def learn(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    """A decision list from labels (doc_id, quality: 0 is bad) of documents whose statistics are given."""
    import numpy as np

    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(sample)
    rows = stats.join(marks, "doc_id").where(~base_failed()).select("order", "doc_id", (F.col("quality") == 0).alias("bad"), *[ratio(k).alias(k) for k in RATIOS]).orderBy("order", "doc_id", *RATIOS).limit(2 * sample).collect()
    return grow({k: np.array([r[k] for r in rows]) for k in RATIOS}, np.array([r["bad"] for r in rows], bool))


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The contract's counts of every document, base_failed and kept."""
    stats = written(statistics(docs), "quality")
    rules = learn(stats, labels, sample)
    return stats.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), (~base_failed() & ~rules.rejects()).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that are kept, with their columns. Fitting reads the labelled documents' texts only."""
    marked = docs.join(labels.where("quality is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    rules = learn(written(statistics(marked), "quality-marked"), labels, sample)
    return statistics(docs, keep_columns=True).where(~base_failed() & ~rules.rejects()).select(*docs.columns)
