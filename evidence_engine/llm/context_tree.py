"""Language-model scores by context-tree weighting, beside a smoothed unigram base.

A byte is eight binary decisions. For each decision there is a tree of contexts: none, the last byte, the
last two and so on to depth. Each node's Krichevsky-Trofimov estimate of what training documents did there
is mixed with what the longer contexts say, in the proportion in which each has predicted the training
data. The model's probability of a byte is the product over its decisions; its log2 with the sign changed
is the code length.

What is learned covers all training documents and grows with them. Each shard asks the buckets (see
shards.py) for the counts of its own words, and for what its own contexts with the byte after them come to.
A bucket owns contexts of TOP + 1 bytes with all that is longer, so it weights those trees from the longest
contexts up; what they hand to the contexts of TOP bytes is added up over all buckets, and only the model of
these short contexts (at most 2**24 decisions, for any corpus) is broadcast, back to the buckets.

Defined results: null and empty texts have one token, the end, and model score 0; a null doc_id is a
training document; repeated rows count and are scored each; without training documents the base divides
the smoothing mass alone and the model takes all bytes to be alike; an empty table gives no rows; columns
beside doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm import shards as S
from evidence_engine.llm.common import parallelism, written
from evidence_engine.llm.jaccard_join import mixed

#: Bytes of context that op6 learns, and of those contexts that every task of a bucket has the model of.
DEPTH, TOP = 6, 2
#: Codes that a bucket takes in before it drops repeats.
AT_ONCE = 1 << 21
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def held_out(doc_id: int, folds: int = 5, fold: int = 1) -> bool:
    return zlib.crc32(b"" if doc_id == -(2**63) else str(doc_id).encode()) % folds == fold


def words_of(ends, raw: bytes):
    """Sorted hashes of a shard's distinct words, and for each word its place there and its text."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    texts = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(np.ascontiguousarray(ends, "<i8")), pa.py_buffer(raw.translate(LOWER)))
    split = pc.ascii_split_whitespace(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy()
    keep = np.fromiter(map(bool, words), bool, len(words))[code] if len(words) else np.zeros(0, bool)
    code, doc = code[keep], doc[keep]
    hashes, place = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words)), return_inverse=True)
    return hashes, place[code] if len(words) else code, doc


def cuts(hashes, bucket_bits: int):
    import numpy as np

    return np.searchsorted(hashes, np.arange(1 << bucket_bits, dtype="u8") << np.uint64(64 - bucket_bits)).tolist() + [len(hashes)]


def word_counts(shards: DataFrame, bucket_bits: int, tasks: int) -> DataFrame:
    """For each shard and bucket the training counts of the shard's words; the buckets' summaries: words counted, distinct ones."""

    def question(ids, ends, raw):
        import numpy as np

        hashes, place, doc = words_of(ends, raw)
        train = np.array([not held_out(d) for d in ids.tolist()], bool)
        n = np.bincount(place[train[doc]], minlength=len(hashes))
        edges = cuts(hashes, bucket_bits)
        for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if j > i:
                yield b, S.join_blobs(S.pack_sorted(hashes[i:j]), S.pack(n[i:j]))

    def answering(blobs):
        import numpy as np

        parts = [(S.unpack_sorted(h), S.unpack(n)) for h, n in map(S.split_blobs, blobs)]
        every, place = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        total = np.zeros(len(every), "u8")
        np.add.at(total, place, np.concatenate([n for _, n in parts]))
        out, at = [], 0
        for h, _ in parts:
            out.append(S.pack(total[place[at : at + len(h)]]))
            at += len(h)
        return [*out, f"{int(total.sum())},{int((total > 0).sum())}".encode()]

    return S.answer(S.ask(shards, question), answering, tasks)


def context_codes(ends, raw: bytes, depth: int):
    """For each byte one number: the bytes before it in its text (0 before the first), the last one highest, then itself."""
    import numpy as np

    x = np.frombuffer(raw, "u1").astype("u8")
    place = np.arange(len(x)) - np.repeat(ends[:-1], np.diff(ends))
    code = x.copy()
    for d in range(1, depth + 1):
        code[d:] |= np.where(place[d:] >= d, x[:-d], np.uint64(0)) << np.uint64(8 * (depth - d + 1))
    return code


def distinct(x):
    """Sorted distinct values, and how often each is there."""
    import numpy as np

    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([np.ones(len(x[:1]), bool), x[1:] != x[:-1]]))
    return x[at], np.diff(at, append=len(x))


def by_bucket(codes, depth: int, bucket_bits: int):
    """The order that puts sorted codes into buckets by their contexts of TOP + 1 bytes, and the buckets' edges there."""
    import numpy as np

    context = (codes >> np.uint64(8 * (depth - top_of(depth)))) & np.uint64(0xFFFFFFFF)
    bucket = (mixed(context) >> np.uint64(64 - bucket_bits)).astype("u4")
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange((1 << bucket_bits) + 1)).tolist()


def top_of(depth: int) -> int:
    return min(TOP, depth - 1)


def lgamma(x):
    """Of an array of numbers above 0."""
    import numpy as np

    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(shift)


def evidence(zeros, ones):
    """The log of the Krichevsky-Trofimov probability of all decisions at a node."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - math.log(math.pi) - lgamma(zeros + ones + 1)


def estimate(zeros, ones):
    """That the next one is 1."""
    return (ones + 0.5) / (zeros + ones + 1)


def levels(codes, n, depth: int, least: int):
    """From depth to least: a depth's sorted (context, byte), their counts and each code's place among them."""
    import numpy as np

    place = np.arange(len(codes))
    out = [(codes, n, place)]
    for _ in range(depth, least, -1):
        codes, up = np.unique(codes >> np.uint64(16) << np.uint64(8) | codes & np.uint64(0xFF), return_inverse=True)
        n = np.bincount(up, weights=n, minlength=len(codes))
        place = up[place]
        out.append((codes, n, place))
    return out


def nodes(codes, n, bit: int):
    """Of a depth's (context, byte): the decisions on that bit as context and bits before it, their counts, each code's place."""
    import numpy as np

    key = codes >> np.uint64(8 - bit)
    new = np.concatenate([np.ones(len(key[:1]), bool), key[1:] != key[:-1]])
    which = np.cumsum(new) - 1
    total = np.bincount(which, weights=n)
    ones = np.bincount(which, weights=n * (codes >> np.uint64(7 - bit) & np.uint64(1)))
    return key[new], total - ones, ones, which


def longest(codes, n, depth: int):
    """For each bit of a bucket's codes: what its contexts longer than top_of(depth) come to.

    Yields the bit, each code's probability that it is 1, then the decisions at top_of(depth) with their
    counts here and the sums of what the weighted evidence of their longer contexts is.
    """
    import numpy as np

    half, every = math.log(0.5), levels(codes, n, depth, top_of(depth))
    for bit in range(8):
        below, down = None, []
        for k, (c, m, place) in enumerate(every[:-1]):
            key, zeros, ones, which = nodes(c, m, bit)
            mix, stay = evidence(zeros, ones), np.ones(len(key))
            if k:
                own = half + mix
                mix = np.logaddexp(own, half + below)
                stay = np.exp(own - mix)
            down.append((estimate(zeros, ones), stay, which[place]))
            up = key >> np.uint64(8 + bit) << np.uint64(bit) | key & np.uint64((1 << bit) - 1)
            below = np.bincount(np.unique(up, return_inverse=True)[1], weights=mix)
        p = None
        for own, stay, at in down:
            p = own[at] if p is None else stay[at] * own[at] + (1 - stay[at]) * p
        key, zeros, ones, _ = nodes(*every[-1][:2], bit)
        yield bit, p, named(key, bit), zeros, ones, below


def named(key, bit: int):
    """Decisions of all bits as numbers that differ: the context, a 1 and the bits before."""
    import numpy as np

    return key >> np.uint64(bit) << np.uint64(8) | key & np.uint64((1 << bit) - 1) | np.uint64(1 << bit)


def shortest(key, zeros, ones, below, top: int):
    """What contexts of at most top bytes say: the probability of 1 is a + b times that of the longer contexts."""
    import numpy as np

    half, place = math.log(0.5), np.arange(len(key))
    a, b = np.zeros(len(key)), np.ones(len(key))
    for d in range(top, -1, -1):
        own = half + evidence(zeros, ones)
        mix = np.logaddexp(own, half + below)
        stay = np.exp(own - mix)
        a = (stay * estimate(zeros, ones))[place] + (1 - stay)[place] * a
        b = (1 - stay)[place] * b
        if d:
            key, up = np.unique(key >> np.uint64(16) << np.uint64(8) | key & np.uint64(0xFF), return_inverse=True)
            zeros, ones, below = (np.bincount(up, weights=x, minlength=len(key)) for x in (zeros, ones, mix))
            place = up[place]
    return a, b


def context_counts(shards: DataFrame, depth: int, bucket_bits: int, tasks: int) -> DataFrame:
    """For each shard and bucket the places of the shard's codes among the bucket's; the buckets' summaries: codes, counts and, by longest(), decisions."""

    def question(ids, ends, raw):
        import numpy as np

        code = context_codes(ends, raw, depth)
        train = np.repeat([not held_out(d) for d in ids.tolist()], np.diff(ends)).astype(bool)
        known, times = distinct(code[train])
        every = distinct(np.concatenate([known, distinct(code[~train])[0]]))[0]
        n = np.zeros(len(every), "u8")
        n[np.searchsorted(every, known)] = times
        order, edges = by_bucket(every, depth, bucket_bits)
        every, n = every[order], n[order]
        for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if j > i:
                yield b, S.join_blobs(S.pack_sorted(every[i:j]), S.pack(n[i:j]))

    def answering(blobs):
        import numpy as np

        # some shards at a time: what is kept are the bucket's distinct codes, not all that were sent
        codes, some, size = np.zeros(0, "u8"), [], 0
        for b in blobs:
            some.append(S.unpack_sorted(S.split_blobs(b)[0]))
            size += len(some[-1])
            if size > max(AT_ONCE, len(codes)):
                codes, some, size = distinct(np.concatenate([codes, *some]))[0], [], 0
        codes = distinct(np.concatenate([codes, *some]))[0]
        total = np.zeros(len(codes), "u8")
        for b in blobs:
            c, n = S.split_blobs(b)
            at = np.searchsorted(codes, S.unpack_sorted(c))
            total[at] += S.unpack(n)
            yield S.pack_sorted(at.astype("u8"))
        key, zeros, ones, below = (np.concatenate(x) for x in list(zip(*longest(codes, total, depth), strict=True))[2:])
        order = np.argsort(key)
        summary = (S.pack_sorted(codes), S.pack(total), S.pack_sorted(key[order]), S.pack(zeros[order].astype("u8")), S.pack(ones[order].astype("u8")), below[order].tobytes())
        yield S.join_blobs(*summary)

    return S.answer(S.ask(shards, question), answering, tasks)


def model(counts: DataFrame, depth: int) -> tuple:
    """shortest() of all buckets' decisions. One task builds it: with contexts of TOP bytes there are at most 2**24 of them, however large the corpus is."""

    def decisions(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                _, _, key, zeros, ones, below = S.split_blobs(blob)
                columns = S.unpack_sorted(key).view("i8"), S.unpack(zeros).view("i8"), S.unpack(ones).view("i8"), np.frombuffer(below, "f8")
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "zeros", "ones", "below"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        got = [tuple(b.column(k).to_numpy() for k in range(4)) for b in batches]
        key, zeros, ones, below = (np.concatenate([np.zeros(0, t), *(g[k] for g in got)]) for k, t in enumerate(("i8", "i8", "i8", "f8")))
        order = np.argsort(key)
        key = key[order].astype("u8")
        a, b = shortest(key, zeros[order].astype("f8"), ones[order].astype("f8"), below[order], top_of(depth))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (key, a, b)], ["key", "a", "b"])

    rows = counts.where("shard = -1").select("blob").mapInArrow(decisions, "key long, zeros long, ones long, below double")
    # added up in many tasks; the one that builds the model gets a row for each decision
    rows = rows.groupBy("key").agg(F.sum("zeros"), F.sum("ones"), F.sum("below"))
    row = rows.repartition(1).mapInArrow(run, "key binary, a binary, b binary").first()
    return tuple(map(bytes, row)) if row is not None else (b"", b"", b"")


def context_scores(counts: DataFrame, depth: int, shared, tasks: int) -> DataFrame:
    """For each shard and bucket the log10-probabilities (float32) of the shard's codes."""

    def answering(blobs):
        import numpy as np

        # the summary is the bucket's first row
        codes, n = (f(b) for f, b in zip((S.unpack_sorted, S.unpack), S.split_blobs(blobs[0]), strict=False))
        key, a, b = (np.frombuffer(x, t) for x, t in zip(shared.value, ("u8", "f8", "f8"), strict=True))
        logs, of = np.zeros(len(codes)), codes >> np.uint64(8 * (depth - top_of(depth) + 1)) << np.uint64(8) | codes & np.uint64(0xFF)
        for bit, p, *_ in longest(codes, n, depth):
            at = np.searchsorted(key, named(of >> np.uint64(8 - bit), bit))
            p = a[at] + b[at] * p
            logs += np.log10(np.where(codes >> np.uint64(7 - bit) & np.uint64(1), p, 1 - p))
        logs = logs.astype("<f4").view("<u4")
        yield b""
        yield from (S.pack(logs[S.unpack_sorted(x).astype("i8")]) for x in blobs[1:])

    return S.answer(counts, answering, tasks).where("shard >= 0")


def scored(docs: DataFrame, depth: int = 2) -> DataFrame:
    """SCORES of every document, by contexts of 1 to 7 bytes at most; n_bytes turns score into code length: -log2(10) * score / n_bytes bits a byte."""
    spark = docs.sparkSession
    shards = S.make(docs.select("doc_id", "text"))
    total = shards.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    tasks = parallelism(spark)
    buckets = S.n_buckets(total // 20, tasks)
    bucket_bits = buckets.bit_length() - 1
    answers = written(word_counts(shards, bucket_bits, max(tasks, buckets)), "word-counts")
    sums = F.split(F.col("blob").cast("string"), ",")
    n_words, kinds = answers.where("shard = -1").agg(F.coalesce(F.sum(sums[0].cast("long")), F.lit(0)), F.coalesce(F.sum(sums[1].cast("long")), F.lit(0))).first()
    ends = docs.where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 1).count()
    train_tokens, vocabulary = n_words + ends, kinds + (ends > 0)
    mass = train_tokens + 0.5 * (vocabulary + 1)
    code_buckets = S.n_buckets(total // 4, tasks, 1_000_000)
    code_bits = code_buckets.bit_length() - 1
    counts = written(context_counts(shards, depth, code_bits, max(tasks, code_buckets)), "context-counts")
    shared = spark.sparkContext.broadcast(model(counts, depth))
    scores = context_scores(counts, depth, shared, max(tasks, code_buckets))
    # buckets of contexts have the numbers below 0
    answers = answers.where("shard >= 0").unionByName(scores.withColumn("bucket", -1 - F.col("bucket")))

    def telling(ids, ends_of, raw, answers, shard):
        import numpy as np
        import pyarrow as pa

        hashes, place, doc = words_of(ends_of, raw)
        counts, edges = np.zeros(len(hashes)), cuts(hashes, bucket_bits)
        code = context_codes(ends_of, raw, depth)
        order = np.argsort(code)
        new = np.diff(code[order], prepend=~code[order[:1]]) != 0
        into, code_edges = by_bucket(code[order[new]], depth, code_bits)
        logs_of = np.zeros(len(into), "f4")
        for b, blob in answers.items():
            if b >= 0:
                counts[edges[b] : edges[b + 1]] = S.unpack(blob)
            else:
                logs_of[into[code_edges[-1 - b] : code_edges[-b]]] = S.unpack(blob).astype("<u4").view("<f4")
        each = np.zeros(len(code), "f4")
        each[order] = logs_of[np.cumsum(new) - 1]
        n = len(ids)
        of = counts[place]
        base = np.bincount(doc, weights=np.log10((of + 0.5) / mass), minlength=n) + math.log10((ends + 0.5) / mass)
        logs = np.concatenate([[0.0], np.cumsum(each, dtype="f8")])
        n_tokens = np.bincount(doc, minlength=n) + 1
        n_known = np.bincount(doc, weights=of > 0, minlength=n).astype("i8") + (ends > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (ids, [held_out(d) for d in ids.tolist()], n_tokens, n_known, np.full(n, train_tokens, "i8"), base, logs[ends_of[1:]] - logs[ends_of[:-1]], np.diff(ends_of))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"],
        )

    rows = S.told(shards, answers, telling, SCORES)
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))
