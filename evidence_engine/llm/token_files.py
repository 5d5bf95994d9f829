"""Token ids in seekable binary files.

A file is a row of independent zstandard frames, one for each document, then a skippable frame that
lists the documents, then the seek table of the public zstandard seekable format: for each frame its
compressed size, its size and the low 32 bits of its XXH64. A reader finds a document in the index,
adds up sizes to its frame, checks that frame's checksum and decompresses nothing else.

Ids are little-endian unsigned integers of 2 bytes where the vocabulary allows it and of 4 otherwise.

Defined results: a null or empty text has the end id alone; repeated rows and repeated doc_ids are
written each (ties in doc_id by a hash of their texts); a null doc_id sorts first; an empty table gives no file; a text of any length is one frame, which its task holds whole.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidence_engine.llm.common import open_input, open_output, parallelism, shared_dir, written
from evidence_engine.llm.pieces import PieceEncoder, gathered, released, slices

#: The public seekable format's numbers.
INDEX_MAGIC, SEEK_MAGIC, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
#: The most documents of a file, and bytes after which no more are added to it.
DOCS_PER_FILE, FILE_BYTES = 5_000, 64 << 20
MANIFEST = "file long, path string, n_docs long, n_tokens long, n_bytes long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class FileWriter:
    """Frames in, one file out; the seek table comes last, so nothing is kept but the sizes."""

    def __init__(self, uri: str, width: int):
        self.uri, self.width, self.out = uri, width, open_output(uri)
        self.entries, self.docs, self.n_tokens, self.n_bytes = [], [], 0, 0

    def add(self, doc_id: int | None, n_tokens: int, frame: bytes, n_bytes: int, xxh32: int) -> None:
        self.out.write(frame)
        self.entries.append((len(frame), n_bytes, xxh32))
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None, n_tokens))
        self.n_tokens += n_tokens
        self.n_bytes += len(frame)

    def close(self) -> tuple:
        index = struct.pack("<BI", self.width, len(self.docs)) + b"".join(struct.pack("<q?Q", *d) for d in self.docs)
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEK_END)
        tail = struct.pack("<II", INDEX_MAGIC, len(index)) + index + struct.pack("<II", SEEK_MAGIC, len(table)) + table
        self.out.write(tail)
        self.out.close()
        return self.uri, len(self.docs), self.n_tokens, self.n_bytes + len(tail)


class FileReader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        import numpy as np

        self.file = open_input(uri)
        self.file.seek(0, 2)
        size = self.file.tell()
        self.file.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEK_END or flags != CHECKSUMS:
            raise ValueError(f"{uri}: no seek table")
        table = size - 17 - 12 * count
        self.file.seek(table)
        if struct.unpack("<II", self.file.read(8)) != (SEEK_MAGIC, 12 * count + 9):
            raise ValueError(f"{uri}: broken seek table")
        self.entries = np.frombuffer(self.file.read(12 * count), "<u4").reshape(-1, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype="int64")])
        self.file.seek(int(self.offsets[-1]))
        magic, n = struct.unpack("<II", self.file.read(8))
        if magic != INDEX_MAGIC:
            raise ValueError(f"{uri}: no index of documents")
        self.width, count = struct.unpack("<BI", self.file.read(5))
        self.docs = [(None if null else d, k) for d, null, k in struct.iter_unpack("<q?Q", self.file.read(n - 5))]

    def ids(self, k: int):
        """The ids of the file's k-th document; its frame alone is read and decompressed."""
        import numpy as np
        import xxhash
        import zstandard

        self.file.seek(int(self.offsets[k]))
        size, n_bytes, check = map(int, self.entries[k])
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(size), max_output_size=n_bytes)
        if len(raw) != n_bytes or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError("a frame's checksum differs")
        return np.frombuffer(raw, f"<u{self.width}")

    def close(self) -> None:
        self.file.close()


@lru_cache(maxsize=2)
def library(path: str):
    """The tokenizers library with this file, and its memory of pieces; both last as long as the Python worker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, PieceEncoder(grouped(tokenizer))


def grouped(tokenizer, size: int = 256):
    """Ids of each of many pieces. Words of Latin letters go to the library size at a time, with spaces between them:

    each of them gives one run of ids, whose last token alone has the mark of a word's end. Other pieces,
    and groups whose runs don't come out even, go one by one.
    """
    import numpy as np

    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(pieces: list[str]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        words = [k for k, p in enumerate(pieces) if p.isalpha() and (p.isascii() or max(p) <= "\u00ff")]
        groups = [words[k : k + size] for k in range(0, len(words), size)]
        for group, e in zip(groups, tokenizer.encode_batch_fast([" ".join([pieces[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = e.ids
            cut = (np.flatnonzero(ends[ids]) + 1).tolist()
            if len(cut) == len(group):
                for k, a, b in zip(group, [0, *cut], cut, strict=False):
                    out[k] = ids[a:b]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(rest, tokenizer.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    return encode


def write_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, docs_per_file: int = DOCS_PER_FILE, file_bytes: int = FILE_BYTES, level: int = 3) -> DataFrame:
    """Encode every text and write the files; returns their manifest, itself written in the shared folder.

    Texts are dealt by ranges of (doc_id, hash of the text), so a doc_id with very many rows is split too.
    Each task sorts its range, encodes it and streams it into files, and begins a new file where one has
    docs_per_file documents or file_bytes bytes; a file's number is its task's and its place there.
    """
    spark = docs.sparkSession
    tasks = max(parallelism(spark), -(-docs.count() // docs_per_file))

    def write(batches):
        import os
        import uuid

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa
        import xxhash
        import zstandard
        from pyspark import TaskContext

        tokenizer, encoder = library(tokenizer_path)
        width = 2 if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        zip_ = zstandard.ZstdCompressor(level=level)
        end, task = np.asarray([end_id], f"<u{width}").tobytes(), TaskContext.get().partitionId()
        writer, done = None, []
        # pieces that texts share are looked up once in each part
        for batch in gathered(batches, "text"):
            for part in slices(batch, "text"):
                codes, ends = encoder.texts(part.column(1).to_pylist())
                short = codes.astype(f"<u{width}")
                for doc_id, a, b in zip(part.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    if writer and (len(writer.docs) >= docs_per_file or writer.n_bytes >= file_bytes):
                        done.append(writer.close())
                        writer = None
                    if not writer:
                        # each attempt writes its own files; the manifest names those of the attempts that counted
                        writer = FileWriter(f"{folder}/tokens-{task:06d}-{len(done):04d}-{uuid.uuid4().hex[:8]}.zst", width)
                    body = short[a:b].tobytes() + end
                    writer.add(doc_id, b - a + 1, zip_.compress(body), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF)
        if writer:
            done.append(writer.close())
        released()
        rows = [((task << 32) + k, *d) for k, d in enumerate(done)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["file", "path", "n_docs", "n_tokens", "n_bytes"])

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(dealt.mapInArrow(write, MANIFEST), "token-manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files, with the number of ids before it in all files."""
    starts = manifest.select("file", "path", (F.sum("n_tokens").over(Window.orderBy("file")) - F.col("n_tokens")).alias("start"))

    def read(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader, rows = FileReader(path), []
                for k, (doc_id, n_tokens) in enumerate(reader.docs):
                    ids = reader.ids(k)
                    if len(ids) != n_tokens:
                        raise ValueError(f"{path}: document {doc_id} has {len(ids)} ids, not {n_tokens}")
                    rows.append((doc_id, start, n_tokens, zlib.crc32(np.asarray(ids, "<u4").tobytes())))
                    start += n_tokens
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts.repartition(parallelism(manifest.sparkSession)).mapInArrow(read, READ)


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 1, docs_per_file: int = DOCS_PER_FILE) -> DataFrame:
    """Write documents as token files in the shared folder and read them back."""
    return read_files(write_files(docs, shared_dir(docs.sparkSession, "token-files", keep=True), tokenizer_path, end_id, docs_per_file))
