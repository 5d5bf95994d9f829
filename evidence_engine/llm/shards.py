"""Documents in shards of a few megabytes, and questions that all shards put to all others.

Some operators must know, of each of the very many things in a text (words, shingles, anchors), what the
whole corpus has of it, and no table of that fits one machine. So each shard sends the distinct things
it has, sorted and front-coded as differences, to the buckets that own them (ranges of a hash); a bucket
adds up and sends each shard the answers in the order of its question. A thing that is in every document
counts once for each shard, so no bucket is hot. Shards are a table in the shared folder: a lost task
reads its own again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm.common import written
from evidence_engine.llm.pieces import released, slices

SHARD = "shard long, n_bytes long, doc_ids binary, sizes binary, texts binary"
PART = "bucket long, shard long, blob binary"
SHARD_BYTES = 4 << 20


def make(docs: DataFrame, most: int = SHARD_BYTES) -> DataFrame:
    """A row for each shard: its documents' ids (int64), their texts' sizes in bytes (int64) and the texts, compressed.

    A null doc_id is kept as the smallest int64, a null text as an empty one.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import zstandard
        from pyspark import TaskContext

        zip_, k = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", most, 100_000):
                text = pc.fill_null(part.column(1), "")
                sizes = pc.binary_length(text).to_numpy().astype("<i8")
                raw = b"".join(text.cast(pa.large_binary()).to_pylist())
                ids = pc.fill_null(part.column(0), -(2**63)).to_numpy().astype("<i8")
                row = (k, len(raw), ids.tobytes(), np.asarray(sizes).tobytes(), zip_.compress(raw))
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["shard", "n_bytes", "doc_ids", "sizes", "texts"])
        released()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SHARD), "shards")


def opened(ids: bytes, sizes: bytes, texts: bytes):
    """A shard's ids, the places of its texts (one more than there are texts) and their bytes."""
    import numpy as np
    import zstandard

    sizes = np.frombuffer(sizes, "<i8")
    ends = np.concatenate([[0], np.cumsum(sizes)])
    raw = zstandard.ZstdDecompressor().decompress(texts, max_output_size=int(ends[-1])) if ends[-1] else b""
    return np.frombuffer(ids, "<i8"), ends, raw


def pack(values) -> bytes:
    """Sorted whole numbers, or any small ones, as zstandard-compressed byte planes."""
    import numpy as np
    import zstandard

    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    planes = values.astype(f"<u{width}").view("u1").reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes):
    import numpy as np
    import zstandard

    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), "u1").reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype("u8")


def pack_sorted(values) -> bytes:
    import numpy as np

    return pack(np.diff(values, prepend=np.zeros(1, "u8")))


def unpack_sorted(blob: bytes):
    import numpy as np

    return np.cumsum(unpack(blob), dtype="u8")


def join_blobs(*blobs: bytes) -> bytes:
    return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)


def split_blobs(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def ask(shards: DataFrame, question: Callable[..., Iterator[tuple[int, bytes]]]) -> DataFrame:
    """question(ids, ends, raw) yields (bucket, blob) for a shard."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for shard, *rest in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_ids", "sizes", "texts")), strict=True):
                parts = list(question(*opened(*rest)))
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([shard] * len(parts), pa.int64()), pa.array([p[1] for p in parts], pa.binary())], ["bucket", "shard", "blob"])
        released()

    return shards.select("shard", "doc_ids", "sizes", "texts").mapInArrow(run, PART)


#: Of answers that go on together.
BATCH_BYTES = 8 << 20


def answer(questions: DataFrame, answering: Callable[[list[bytes]], Iterable[bytes]], tasks: int) -> DataFrame:
    """answering(blobs of one bucket) gives a blob for each, in order; rows are (bucket, shard, blob).

    One blob more than it got is a summary of the bucket; its row has shard -1. Answers go on as they are made.
    """

    def run(batches):
        import pyarrow as pa

        def groups():
            bucket, rows = None, []
            for batch in batches:
                for b, shard, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "shard", "blob")), strict=True):
                    if b != bucket and rows:
                        yield bucket, rows
                        rows = []
                    bucket = b
                    rows.append((shard, blob))
            if rows:
                yield bucket, rows

        def batch_of(bucket, part):
            return pa.RecordBatch.from_arrays([pa.array([bucket] * len(part), pa.int64()), pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.binary())], ["bucket", "shard", "blob"])

        for bucket, rows in groups():
            part, size = [], 0
            for to, blob in zip([*(r[0] for r in rows), -1], answering([r[1] for r in rows]), strict=False):
                part.append((to, blob))
                size += len(blob)
                if size > BATCH_BYTES:
                    yield batch_of(bucket, part)
                    part, size = [], 0
            if part:
                yield batch_of(bucket, part)
        released()

    return questions.repartition(tasks, "bucket").sortWithinPartitions("bucket", "shard").mapInArrow(run, PART)


def told(shards: DataFrame, answers: DataFrame, telling: Callable, schema: str) -> DataFrame:
    """telling(ids, ends, raw, blobs by bucket, shard) yields record batches for a shard that has its answers."""
    gathered = answers.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "blob"))).alias("answers"))
    rows = shards.select("shard", "doc_ids", "sizes", "texts").join(gathered, "shard", "left")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                shard, ids, sizes, texts, answers = (row.column(c).to_pylist()[0] for c in ("shard", "doc_ids", "sizes", "texts", "answers"))
                yield from telling(*opened(ids, sizes, texts), dict(answers or []), shard)
        released()

    return rows.mapInArrow(run, schema)


def n_buckets(n_things: int, least: int, per_bucket: int = 2_000_000) -> int:
    """A power of two."""
    return 1 << max(1, (max(least, -(-n_things // per_bucket)) - 1).bit_length())
