"""Exact removal of repeated substrings by a distributed merge sort of suffixes that never compares a known prefix twice.

A byte goes if some string of `length` bytes over it starts earlier too (in a smaller doc_id, or in the
same document at an earlier start).

Not every suffix has to be sorted. Every window of `length` bytes has an anchor: the place of the smallest
hash of `gram` bytes in it, the leftmost of equals. Equal windows have equal anchors at equal distances,
so it is enough to sort the suffixes that start at anchors, about one byte in forty, and of those only the
ones whose first `gram` bytes start another anchor's suffix somewhere (as distinguishing-prefix sorting
leaves out what is known to be unique). Each such suffix carries the bytes before it that its windows reach.

Each shard sorts its suffixes into runs, one for each range of the order (by hash of the gram, then by
bytes; hashes are uniform, so ranges need no sample). Runs are sent front-coded: of each suffix the length
of the prefix shared with the one before, and the rest. Whoever owns a range merges its runs with a loser
tree. Its nodes keep how much of each loser is shared with the winner that beat it; heads with different
shared lengths are ordered by those alone, and only equal ones are compared, from there on. The tree gives
the merged order and the shared prefixes of neighbours. For each distance from the anchor, neighbours that
share enough to the right and agree to the left are equal windows; all but the earliest go.

A gram that very many anchors have, with other bytes around it each time, would make one range large. Its
windows fall into classes by their distance from the anchor. All windows of a class share a stretch of at
least length * (1 - 1 / CLASSES) bytes or so around it, and the hash of that stretch takes the gram's place
in the order: a class's windows are equal only if their stretches are, and stretches spread over all ranges.

Suffixes that are equal in one shard, with what is before them, travel once, however many copies there are.

Defined results: null and empty texts have 0 bytes and keep the digest of nothing; texts of fewer than
`length` bytes lose nothing; of repeated rows and rows of one doc_id the first in the table of shards counts
as the earlier one; a null doc_id comes before all others; an empty table gives no rows; columns beside
doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm import shards as S
from evidence_engine.llm.common import parallelism, written

LENGTH, GRAM = 100, 16
#: Anchors that a gram has when its suffixes are dealt by more than the gram, and into how many classes their windows fall then.
HOT, CLASSES = 100_000, 8
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"
FAN_IN = 256
MULTIPLY = 0x9E3779B97F4A7C15


def gram_hashes(raw: bytes, gram: int):
    """A 64-bit hash of the bytes from each place on; gram is a power of two."""
    import numpy as np

    letters = np.random.default_rng(29).integers(1, 2**63, 256, dtype="u8")
    h, width, power = letters[np.frombuffer(raw, "u1")], 1, MULTIPLY
    while width < gram:
        h = h[:-width] * np.uint64(power) + h[width:]
        width, power = 2 * width, power * power & 0xFFFFFFFFFFFFFFFF
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def sliding_least(x, width: int):
    import numpy as np

    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(ends, raw: bytes, length: int, gram: int, step: int = 1 << 18):
    """Anchors of a shard: hash, place, and the first and last start of the windows that have it; step windows at a time."""
    import numpy as np

    parts = [[np.zeros(0, "u8")], *[[np.zeros(0, "i8")] for _ in range(4)]]
    for at in range(0, len(raw) - length + 1, step):
        upto = min(at + step, len(raw) - length + 1)
        h = gram_hashes(raw[at : upto + length - 1], gram)
        # the place breaks ties, so the leftmost of equals is the least
        least = sliding_least((h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype="u8"), length - gram + 1)
        place, starts = (least & np.uint64(0xFFFFFF)).astype("i8"), np.arange(at, upto)
        doc = np.searchsorted(ends, starts, "right") - 1
        inside = ends[doc + 1] >= starts + length
        place, starts, doc = place[inside], starts[inside], doc[inside]
        if not len(place):
            continue
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
        last = np.r_[first[1:], len(place)] - 1
        for part, x in zip(parts, (h[place[first]], place[first] + at, starts[first], starts[last], doc[first]), strict=True):
            part.append(x)
    hashes, place, first, last, doc = map(np.concatenate, parts)
    # windows of one anchor that two steps share
    new = np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])][: len(place)]
    at = np.flatnonzero(new)
    # least hashes are small ones; spread again, they fill all buckets alike
    hashes = hashes * np.uint64(0x94D049BB133111EB)
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return hashes[at], place[at], first[at], last[np.r_[at[1:], len(place)] - 1] if len(at) else last


def prints(hashes, bits: int):
    import numpy as np

    return np.unique(hashes >> np.uint64(64 - bits), return_counts=True)


def edges_of(values, bits: int, bucket_bits: int) -> list[int]:
    import numpy as np

    return np.searchsorted(values, np.arange(1 << bucket_bits, dtype="u8") << np.uint64(bits - bucket_bits)).tolist() + [len(values)]


def shared_grams(shards: DataFrame, length: int, gram: int, bits: int, bucket_bits: int, tasks: int, hot: int) -> DataFrame:
    """For each shard and bucket a bit for each of its fingerprints: whether another anchor has it too; and the places of those that more than hot have."""

    def question(ids, ends, raw):
        import numpy as np

        mine, times = prints(anchors(ends, raw, length, gram)[0], bits)
        edges = edges_of(mine, bits, bucket_bits)
        for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if j > i:
                yield b, S.join_blobs(S.pack_sorted(mine[i:j] - (np.uint64(b) << np.uint64(bits - bucket_bits))), S.pack(times[i:j]))

    def answering(blobs):
        import numpy as np

        parts = [(S.unpack_sorted(p), S.unpack(t).astype("i8")) for p, t in map(S.split_blobs, blobs)]
        every, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([t for _, t in parts]), minlength=len(every))
        out, at = [], 0
        for p, _ in parts:
            mine = total[place[at : at + len(p)]]
            out.append(S.join_blobs(np.packbits(mine > 1).tobytes(), S.pack_sorted(np.flatnonzero(mine > hot).astype("u8"))))
            at += len(p)
        return out

    return S.answer(S.ask(shards, question), answering, tasks)


def mismatch(a: bytes, b: bytes, at: int) -> int:
    """The first place from `at` on where a and b differ, or the shorter one's length."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (x.bit_length() + 7 >> 3)


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """A sorted run as shared prefix lengths and rests."""
    shared, rests, before = [], [], b""
    for s in strings:
        n = mismatch(before, s, 0)
        shared.append(n)
        rests.append(s[n:])
        before = s
    return shared, rests


def merged(runs: list[tuple[list[int], list[bytes], list[int]]]) -> tuple[list[int], list[bytes], list[int]]:
    """Merge sorted runs of (shared prefix lengths, strings, labels) into one, with a loser tree.

    shared[k] is how much string k has in common with string k - 1 of its run; no such prefix is looked at again.
    """
    while len(runs) > FAN_IN:
        runs = [merged(runs[k : k + FAN_IN]) for k in range(0, len(runs), FAN_IN)]
    if len(runs) == 1:
        return runs[0]
    width = 1 << (len(runs) - 1).bit_length() if runs else 1
    # An ended run loses against all others: nothing is less than a shared length of -1.
    heads = [r[1][0] if r[1] else b"" for r in runs] + [b""] * (width - len(runs))
    common = [0 if r[1] else -1 for r in runs] + [-1] * (width - len(runs))
    at = [0] * width
    losers = [0] * width
    winners = [0] * width + list(range(width))

    def beats(a: int, b: int) -> bool:
        """Whether run a's head comes first; the loser's shared length becomes the one with the winner."""
        x, y = common[a], common[b]
        if x != y:
            return x > y
        if x < 0:
            return a < b
        s, t = heads[a], heads[b]
        m = mismatch(s, t, x)
        less = m == len(s) if m == len(s) or m == len(t) else s[m] < t[m]
        if m == len(s) == len(t):
            less = a < b
        if less:
            common[b] = m
        else:
            common[a] = m
        return less

    for node in range(width - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        if beats(a, b):
            winners[node], losers[node] = a, b
        else:
            winners[node], losers[node] = b, a
    best = winners[1] if width > 1 else 0
    shared, strings, labels = [], [], []
    while common[best] >= 0:
        run_shared, run_strings, run_labels = runs[best]
        k = at[best]
        shared.append(common[best])
        strings.append(heads[best])
        labels.append(run_labels[k])
        at[best] = k = k + 1
        if k < len(run_strings):
            heads[best], common[best] = run_strings[k], run_shared[k]
        else:
            common[best] = -1
        node = (width + best) >> 1
        while node:
            other = losers[node]
            x, y = common[best], common[other]
            if y > x or (x == y and not beats(best, other)):
                losers[node], best = best, other
            node >>= 1
    if shared:
        shared[0] = 0
    return shared, strings, labels


def in_classes(raw: bytes, place, first, last, length: int, gram: int, classes: int = CLASSES):
    """Anchors with a class of their windows each: the hash of what the class's windows share, place, first and last start."""
    import numpy as np
    import xxhash

    edges = np.linspace(0, length - gram + 1, min(classes, length - gram + 1) + 1).astype(int).tolist()
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        # windows that start from low to high - 1 bytes before the anchor
        a, b = np.maximum(first, place - (high - 1)), np.minimum(last, place - low)
        some = np.flatnonzero(a <= b)
        stretches = [xxhash.xxh3_64_intdigest(raw[p - low : p - high + 1 + length], seed=low + 1) for p in place[some].tolist()]
        yield np.array(stretches, "u8"), place[some], a[some], b[some]


def runs(shards: DataFrame, answers: DataFrame, length: int, gram: int, bits: int, gram_bits: int, bucket_bits: int) -> DataFrame:
    """Each shard's front-coded runs, one for each bucket. answers are shared_grams() in buckets of gram_bits."""

    def telling(ids, ends, raw, answers, shard):
        import numpy as np
        import pyarrow as pa
        import zstandard

        hashes, place, first, last = anchors(ends, raw, length, gram)
        mine, _ = prints(hashes, bits)
        edges = edges_of(mine, bits, gram_bits)
        more, often = np.zeros(len(mine), bool), np.zeros(len(mine), bool)
        for b, blob in answers.items():
            n = edges[b + 1] - edges[b]
            known, hot = S.split_blobs(blob)
            more[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(known, "u1"), count=n).astype(bool)
            often[edges[b] + S.unpack_sorted(hot).astype("i8")] = True
        of = np.searchsorted(mine, hashes >> np.uint64(64 - bits))
        keep, often = (x[of] if len(mine) else np.zeros(0, bool) for x in (more, often))
        hashes, place, first, last, often = hashes[keep], place[keep], first[keep], last[keep], often[keep]
        if often.any():
            parts = [(hashes[~often], place[~often], first[~often], last[~often])]
            parts += in_classes(raw, place[often], first[often], last[often], length, gram)
            hashes, place, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        doc = ids[np.searchsorted(ends, place, "right") - 1] if len(place) else np.zeros(0, "i8")
        order = np.lexsort((place, doc)).tolist()
        key, place, first, last, doc = hashes.astype(">u8").tobytes(), place.tolist(), first.tolist(), last.tolist(), doc.tolist()
        items: dict[tuple[bytes, bytes], list[int]] = {}
        for k in order:
            a = place[k]
            items.setdefault((key[8 * k : 8 * k + 8] + raw[a : last[k] + length], raw[first[k] : a]), []).append(k)
        ranked = sorted(items)
        lead = np.frombuffer(b"".join(s[:8] for s, _ in ranked), ">u8").astype("u8")
        edges = edges_of(lead, 64, bucket_bits)
        zip_, parts = zstandard.ZstdCompressor(level=3), []
        for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if j == i:
                continue
            part = ranked[i:j]
            shared, rests = front_coded([s for s, _ in part])
            of = [items[x] for x in part]
            small = lambda x: S.pack(np.array(x, "u8"))
            # a repeated suffix's other places come behind its first one
            blob = S.join_blobs(small(shared), small([len(r) for r in rests]), zip_.compress(b"".join(rests)), small([len(p) for _, p in part]), zip_.compress(b"".join(p for _, p in part)), S.pack(np.array([doc[x[0]] for x in of], "i8").view("u8")), small([len(x) for x in of]), small([place[k] for x in of for k in x]))
            parts.append((b, blob))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([shard] * len(parts), pa.int64()), pa.array([p[1] for p in parts], pa.binary())], ["bucket", "shard", "blob"])

    return S.told(shards, answers, telling, S.PART)


def equal_windows(shared, left_sizes, lefts: bytes, right_sizes, rank, length: int):
    """Which windows of which merged suffixes start earlier too: rows of (suffix, least distance, most distance)."""
    import numpy as np

    n = len(rank)
    widest = int(left_sizes.max(initial=0))
    ends = np.cumsum(left_sizes)
    flat = np.frombuffer(lefts, "u1")
    letters = np.random.default_rng(31).integers(1, 2**63, 256, dtype="u8")
    agree = np.zeros(n, "u8")
    gone = np.zeros((n, widest + 2), bool)
    for d in range(widest + 1):
        if d:
            has = np.flatnonzero(left_sizes >= d)
            agree[has] = (agree[has] ^ letters[flat[ends[has] - d]]) * np.uint64(MULTIPLY)
            agree[has] ^= agree[has] >> np.uint64(29)
        takes = np.flatnonzero((left_sizes >= d) & (right_sizes >= length - d))
        if len(takes) < 2:
            continue
        group = np.cumsum(shared < length - d)[takes]
        # most groups are of one suffix and go at once
        many = np.r_[False, group[1:] == group[:-1]]
        many[:-1] |= many[1:]
        takes, group = takes[many], group[many]
        order = np.lexsort((rank[takes], agree[takes], group))
        g, h = group[order], agree[takes][order]
        again = np.r_[False, (g[1:] == g[:-1]) & (h[1:] == h[:-1])] if len(order) else np.zeros(0, bool)
        gone[takes[order[again]], d + 1] = True
    step = np.diff(np.concatenate([gone.astype("i1"), np.zeros((n, 1), "i1")], axis=1), axis=1)
    row, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    return row, low, high - 1


def removed(sent: DataFrame, length: int, tasks: int) -> DataFrame:
    """For each shard and bucket the byte ranges that go: starts and sizes."""

    def answering(blobs):
        import numpy as np
        import zstandard

        zip_ = zstandard.ZstdDecompressor()
        sources, lists, right_sizes, left_sizes, lefts, docs, many, places, at = [], [], [], [], [], [], [], [], 0
        for b, blob in enumerate(blobs):
            parts = S.split_blobs(blob)
            shared, sizes, before = (S.unpack(parts[k]).astype("i8") for k in (0, 1, 3))
            rests, strings, s, end = zip_.decompress(parts[2]), [], b"", 0
            for c, n in zip(shared.tolist(), sizes.tolist(), strict=True):
                s = s[:c] + rests[end : end + n]
                end += n
                strings.append(s)
            lists.append((shared.tolist(), strings, list(range(at, at + len(strings)))))
            at += len(strings)
            right_sizes.append(shared + sizes - 8)
            left_sizes.append(before)
            lefts.append(zip_.decompress(parts[4]))
            docs.append(S.unpack(parts[5]).view("i8"))
            many.append(S.unpack(parts[6]).astype("i8"))
            places.append(S.unpack(parts[7]).astype("i8"))
            sources.append(np.full(len(strings), b))
        shared, _, label = merged(lists)
        label = np.array(label, "i8")
        right_size, left_size, doc, times, source = map(np.concatenate, (right_sizes, left_sizes, docs, many, sources))
        every = np.concatenate(places)
        first = np.concatenate([[0], np.cumsum(times)])
        rank = np.empty(len(doc), "i8")
        rank[np.lexsort((every[first[:-1]], source, doc))] = np.arange(len(doc))
        # the bytes before, in merged order
        flat, start = np.frombuffer(b"".join(lefts), "u1"), np.concatenate([[0], np.cumsum(left_size)])
        take = left_size[label]
        ends = np.cumsum(take)
        moved = flat[np.repeat(start[label] - (ends - take), take) + np.arange(ends[-1] if len(ends) else 0)]
        # what precedes is compared from the common 8 bytes of hash on
        row, low, high = equal_windows(np.array(shared, "i8") - 8, take, moved.tobytes(), right_size[label], rank[label], length)
        who = label[row]
        begin, size = every[first[who]] - high, high - low + length
        # all places of a suffix but its first lose all its windows
        copies = np.repeat(np.arange(len(doc)), times - 1)
        rest = np.ones(len(every), bool)
        rest[first[:-1]] = False
        lows, highs = (length - right_size)[copies], left_size[copies]
        who, begin, size = np.concatenate([who, copies]), np.concatenate([begin, every[rest] - highs]), np.concatenate([size, highs - lows + length])
        out = []
        for b in range(len(blobs)):
            mine = source[who] == b
            out.append(S.join_blobs(S.pack(begin[mine].astype("u8")), S.pack(size[mine].astype("u8"))))
        return out

    return S.answer(sent, answering, tasks)


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """What goes from every document: counts, the places in bytes, and the bytes that stay with their digest."""
    shards = S.make(docs.select("doc_id", "text"))
    total = shards.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    tasks = parallelism(docs.sparkSession)
    things = total // 40 + 1
    bits = min(64, max(32, things.bit_length() + 12))
    by_gram, by_suffix = S.n_buckets(things, tasks), S.n_buckets(things, tasks, 120_000)
    gram_bits, bucket_bits = by_gram.bit_length() - 1, by_suffix.bit_length() - 1
    grams = written(shared_grams(shards, length, gram, bits, gram_bits, max(tasks, by_gram), hot), "shared-grams")
    gone = removed(runs(shards, grams, length, gram, bits, gram_bits, bucket_bits), length, max(tasks, by_suffix))

    def telling(ids, ends, raw, answers, shard):
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa

        edge = np.zeros(len(raw) + 1, "i4")
        for blob in answers.values():
            begin, size = (S.unpack(x).astype("i8") for x in S.split_blobs(blob))
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + size, -1)
        mask = np.cumsum(edge[:-1]) > 0
        x, cut = np.frombuffer(raw, "u1"), [np.zeros(0, "i8")] * 2
        # no removed run goes from one document into the next
        before = np.r_[False, mask[:-1]] if len(mask) else mask
        after = np.r_[mask[1:], False] if len(mask) else mask
        before[ends[:-1][ends[:-1] < len(mask)]] = False
        after[ends[1:][ends[1:] > 0] - 1] = False
        cut = [np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1]
        first = np.searchsorted(cut[0], ends)
        total = np.concatenate([[0], np.cumsum(mask)])[ends]
        kept = [raw[a:b] if i == j else x[a:b][~mask[a:b]].tobytes() for a, b, i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)]
        doc = np.repeat(np.arange(len(ids)), np.diff(first))
        places = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(c - ends[doc]) for c in cut], ["start", "end"]))
        columns = [pa.array(ids), pa.array(np.diff(ends)), pa.array(np.diff(total)), pa.array(np.diff(first)), pa.array([sha256(k).hexdigest() for k in kept]), places, pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    rows = S.told(shards, gone, telling, RESULT)
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))
