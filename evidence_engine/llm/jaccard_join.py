"""Exact self-join of documents by Jaccard similarity of their word n-grams, and its components.

Set relations save most of the work. Equal sets are one set. For the others every shingle gets its global
document frequency, and sets are ordered rarest first, so that a set whose rarest shingles are its own
asks nobody (a shingle of frequency 1 is in no list). Of the rest only the prefix that a partner must share
goes into index lists.

Lists are cut into blocks by position. Two entries of a list can reach the threshold only if what follows
them is long enough, so an entry visits only the blocks that this bound allows and skips the rest. And a
set's answers come from those of a highly similar set: in each list all entries are compared with its
leader; what links to the same component needs no answer of its own, and of the others only those are
compared whose distances to the leader differ by no more than the triangle inequality allows and whose
sketches don't rule the link out.

Links are judged by counting, with no estimate anywhere: 100 * common >= percent * union. Shingles are
64-bit hashes of words.

Defined results: null texts and texts without words have no shingles and no links; with fewer than n words
the whole sequence is one shingle; repeated rows and equal texts are linked; a null doc_id is
a document like others and never a component's smallest unless all are null; texts of any length are
taken whole, and the task that has one holds its shingles; an empty table gives no rows. Columns beside doc_id and text are not read by linked() and are kept by one_of_each().
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.llm import shards as S
from evidence_engine.llm.common import dropped, parallelism, spread_out, written
from evidence_engine.llm.components import components

MULTIPLY = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Blocks that the positions of a whole set would have, and 64-bit words of a sketch.
BLOCKS, WORDS = 32, 16
SETS = "doc_id long, digest string, n long, key binary, entries array<struct<token:long,pos:int>>, tokens array<long>, bits array<long>"


def mixed(x):
    """Spreads sums over all 64 bits."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(ends, raw: bytes, n: int) -> list:
    """The distinct shingles of each text of a shard, sorted."""
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
    value = np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words))[code]
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    multiply = np.array(MULTIPLY, "u8")
    wide = len(value) - n + 1
    grams = np.zeros(0, "u8")
    if wide > 0:
        grams = mixed(sum(value[k : k + wide] * multiply[k] for k in range(n)))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mixed(np.array([np.sum(value[a:b] * multiply[: b - a]) + np.uint64(b - a)], "u8")))
        else:
            out.append(np.zeros(0, "u8"))
    return out


def distinct_sets(sets: list) -> tuple[list[bytes], dict[bytes, int]]:
    """Each set's key, and the first set of each key."""
    import xxhash

    keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"" for s in sets]
    first: dict[bytes, int] = {}
    for k, key in enumerate(keys):
        if key:
            first.setdefault(key, k)
    return keys, first


def fingerprints(sets: list, first: dict[bytes, int], bits: int):
    """The leading bits of all shingles of a shard's distinct sets, sorted, and how many sets have each."""
    import numpy as np

    every = np.concatenate([np.zeros(0, "u8"), *(sets[k] for k in first.values())])
    return np.unique(every >> np.uint64(64 - bits), return_counts=True)


def prefix_length(size: int, percent: int) -> int:
    """How many of a set's first shingles hold one that any partner shares."""
    return size - (percent * size + 99) // 100 + 1


def frequencies(shards: DataFrame, n: int, bits: int, bucket_bits: int, tasks: int) -> DataFrame:
    """For each shard and bucket: which of its fingerprints (by place) more than one set has, and how many."""
    shift = bits - bucket_bits

    def question(ids, ends, raw):
        import numpy as np

        sets = shingles(ends, raw, n)
        prints, times = fingerprints(sets, distinct_sets(sets)[1], bits)
        cuts = np.searchsorted(prints, np.arange((1 << bucket_bits) + 1, dtype="u8") << np.uint64(shift))
        for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if j > i:
                yield b, S.join_blobs(S.pack_sorted(prints[i:j] - (np.uint64(b) << np.uint64(shift))), S.pack(times[i:j]))

    def answering(blobs):
        import numpy as np

        parts = [(S.unpack_sorted(p), S.unpack(t).astype("i8")) for p, t in map(S.split_blobs, blobs)]
        every, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([t for _, t in parts]), minlength=len(every)).astype("i8")
        out, at = [], 0
        for p, _ in parts:
            mine = total[place[at : at + len(p)]]
            at += len(p)
            where = np.flatnonzero(mine > 1)
            out.append(S.join_blobs(S.pack_sorted(where.astype("u8")), S.pack(mine[where])))
        return out

    return S.answer(S.ask(shards, question), answering, tasks)


def prefixes(shards: DataFrame, answers: DataFrame, n: int, bits: int, bucket_bits: int, percent: int) -> DataFrame:
    """SETS: every document's set; of a shard's distinct sets also the index entries, and all shingles if there are any."""
    shift = bits - bucket_bits

    def telling(ids, ends, raw, answers, shard):
        from hashlib import md5

        import numpy as np
        import pyarrow as pa

        sets = shingles(ends, raw, n)
        keys, first = distinct_sets(sets)
        prints, _ = fingerprints(sets, first, bits)
        frequency = np.ones(len(prints), "i8")
        cuts = np.searchsorted(prints, np.arange((1 << bucket_bits) + 1, dtype="u8") << np.uint64(shift))
        for b, blob in answers.items():
            where, times = map(S.unpack, S.split_blobs(blob))
            frequency[cuts[b] + np.cumsum(where).astype("i8")] = times.astype("i8")
        entries, tokens, sketches = [None] * len(sets), [None] * len(sets), [None] * len(sets)
        for k in first.values():
            s = sets[k]
            mine = frequency[np.searchsorted(prints, s >> np.uint64(64 - bits))]
            p = prefix_length(len(s), percent)
            if np.count_nonzero(mine == 1) >= p:
                continue
            order = np.lexsort((s, mine))[:p]
            at = np.flatnonzero(mine[order] > 1)
            entries[k] = [{"token": t, "pos": i} for t, i in zip(s[order[at]].view("i8").tolist(), at.tolist(), strict=True)]
            tokens[k] = s.view("i8")
            odd = np.bincount((s * np.uint64(MULTIPLY[0])) >> np.uint64(54), minlength=64 * WORDS) & 1
            sketches[k] = np.packbits(odd.astype("u1")).view("i8")
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array([md5(raw[i:j]).hexdigest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()), pa.array([len(s) for s in sets], pa.int64()), pa.array([k or None for k in keys], pa.binary()), pa.array(entries, pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32())]))), pa.array(tokens, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
            ["doc_id", "digest", "n", "key", "entries", "tokens", "bits"],
        )

    return S.told(shards, answers, telling, SETS)


def can_reach(percent: int, a: str, b: str):
    """Whether what follows two entries of a list (n, pos) is enough for a link."""
    rest = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return (F.lit(100 + percent) * rest >= F.lit(percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))) & (F.lit(100) * F.least(f"{a}.n", f"{b}.n") >= F.lit(percent) * F.greatest(f"{a}.n", f"{b}.n"))


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, their distance and whether they link, for distinct pairs of keys (a, b)."""
    left = pairs.join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("b_tokens")), "b")
    both = left.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("a_tokens")), "a")
    both = both.withColumn("common", F.size(F.array_intersect("a_tokens", "b_tokens"))).withColumn("union", F.size("a_tokens") + F.size("b_tokens") - F.col("common"))
    return both.select("a", "b", (1 - F.col("common") / F.col("union")).alias("distance"), (100 * F.col("common") >= percent * F.col("union")).alias("link"))


def leader_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """token, leader and every entry of its list that could link to it. A list's leader has it earliest of all."""
    leaders = entries.groupBy("token").agg(F.min(F.struct("pos", "n", "key")).alias("l"), F.count(F.lit(1)).alias("many")).where("many > 1").select("token", "l")
    return entries.join(spread_out(leaders), "token").select("token", F.col("l.key").alias("a"), F.col("key").alias("b"), F.struct("n", "pos").alias("e"), "l").where("a <> b").where(can_reach(percent, "l", "e")).select("token", "a", "b")


def block_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of keys of different components that blocks leave over.

    entries: token, key, n, pos, component, bits and, where the leader was compared, distance. Lists are cut
    into blocks by relative position. How far back a partner can stand follows from an entry's size and
    position, so an entry goes to those blocks alone, at most as many as BLOCKS, and the join skips the rest.
    Sketches bound the difference of two sets from below: each set bit in which they differ is a shingle
    that only one of them has.
    """
    reach, share = 1 - percent / 100, percent / (100 + percent)
    n, pos = F.col("n").cast("double"), F.col("pos").cast("double")
    largest = F.least(n / (1 - reach), (n - pos) / share - n) + 1e-6
    last = F.floor(F.lit(BLOCKS) * (1 - F.lit(share) * (1 + n / largest)) + 1e-6).cast("int")
    x = entries.withColumn("last", last).where("last >= 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last")))).alias("x")
    y = entries.withColumn("block", F.floor(F.lit(BLOCKS) * pos / n).cast("int")).alias("y")
    differ = sum((F.bit_count(F.get("x.bits", F.lit(k)).bitwiseXOR(F.get("y.bits", F.lit(k)))) for k in range(WORDS)), F.lit(0))
    condition = (
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.block") == F.col("y.block"))
        & (F.col("x.component") < F.col("y.component"))
        & can_reach(percent, "x", "y")
        & (F.col("x.distance").isNull() | F.col("y.distance").isNull() | (F.abs(F.col("x.distance") - F.col("y.distance")) <= reach + 1e-9))
        & (F.lit(100 + percent) * differ <= F.lit(100 - percent) * (F.col("x.n") + F.col("y.n")))
    )
    return x.join(y, condition).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def placed(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, digest of the text, n_shingles and key of every document; key, component and least doc_id of every set."""
    spark = docs.sparkSession
    shards = S.make(docs.select("doc_id", "text"))
    total = shards.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    things = total // 5 + 1
    bits = min(64, max(32, math.ceil(math.log2(things)) + 6))
    tasks = parallelism(spark)
    buckets = S.n_buckets(things, tasks)
    answers = written(frequencies(shards, n, bits, buckets.bit_length() - 1, max(tasks, buckets)), "shingle-frequencies")
    sets = written(prefixes(shards, answers, n, bits, buckets.bit_length() - 1, percent), "shingle-sets")
    dropped(shards)
    members = sets.select(F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("doc_id"), "digest", F.col("n").alias("n_shingles"), "key")
    indexed = sets.where("entries is not null")
    entries = written(indexed.select("key", "n", F.explode("entries").alias("e")).select(F.col("e.token").alias("token"), "key", "n", F.col("e.pos").alias("pos")).distinct(), "shingle-entries")
    # a table of its own: four joins read it, and pairs of a set with very many are split in each
    whole = written(indexed.groupBy("key").agg(F.first("tokens").alias("tokens"), F.first("bits").alias("bits")), "distinct-sets")

    with_leader = written(leader_pairs(entries, percent), "leader-pairs")
    judged = written(compared(with_leader.select("a", "b").distinct(), whole, percent), "leader-links")
    links = judged.where("link").select("a", "b")
    nodes = written(components(links), "leader-components")
    # lists that hold more than one component
    sorted_out = entries.join(nodes, entries["key"] == nodes["node"], "left").select("token", "key", "n", "pos", F.coalesce("component", "key").alias("component"))
    split = sorted_out.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("token")
    distance = with_leader.join(judged.select("a", "b", "distance"), ["a", "b"]).select("token", F.col("b").alias("key"), "distance")
    sketches = whole.select("key", "bits")
    left = written(sorted_out.join(spread_out(split), "token").join(distance, ["token", "key"], "left").join(sketches, "key"), "split-lists")
    rest = compared(written(block_pairs(left, percent), "block-pairs"), whole, percent).where("link").select("a", "b")
    # what is new ties components together
    of = lambda k: nodes.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}"))
    ties = rest.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    tied = components(ties).select(F.col("node").alias("component"), F.col("component").alias("tied"))
    alone = ties.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node", "left_anti").select("node", F.col("node").alias("component"))
    nodes = nodes.unionByName(alone).join(tied, "component", "left").select("node", F.coalesce("tied", "component").alias("component"))

    keys = members.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least")).join(nodes.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    return members, keys


def linked(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of every document."""
    members, keys = placed(docs, n, percent)
    ids = keys.join(keys.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("key", "component_id")
    return members.join(spread_out(ids), "key", "left").select("doc_id", "n_shingles", F.coalesce(F.when(F.col("key").isNotNull(), F.col("component_id")), "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """The documents of which each component keeps the one with the smallest doc_id (a null one comes last), then the smallest digest of its text.

    Texts without shingles all stay. Of rows that have both doc_id and text alike one stays.
    """
    members, keys = placed(docs, n, percent)
    of = members.join(spread_out(keys.select("key", "component")), "key", "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "digest")).alias("first")
    kept = of.where("component is not null").groupBy("component").agg(first).select("first.doc_id", "first.digest")
    kept = kept.unionByName(of.where("component is null").select("doc_id", "digest")).select(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept_digest"))
    rows = docs.withColumn("_digest", F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_kept_id"]) & (rows["_digest"] == kept["_kept_digest"]), "left_semi")
    if members.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count():
        plain = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("doc_id", "_digest").orderBy(F.xxhash64(*plain)))).where("_place = 1")
    return rows.select(*docs.columns)
