"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can end its encoding. An automaton of all tokens gives
those that are suffixes of the prefix; such a token t is that one if the last token of the prefix
before t is compatible with t, i.e. the two alone encode to themselves. Back-pointers from the whole
word then spell out the exact ids, without any merge being simulated.

Two tokens are compatible if no merge across their border would come before the merges that built
them: undo the later of the two builds and look for a merge across the border, until nothing is left.

Defined results: null and empty texts have no ids and decode to the empty string; texts of any length
are encoded whole; repeated rows give repeated rows; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm.pieces import PieceEncoder, released, slices

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
END = "</w>"


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(shifted)}


class WordCodec:
    """Encoder and decoder of one vocabulary file whose tokens end words with a suffix mark."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or model.get("dropout") or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path}: not a vocabulary of the kind that this codec reads")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word_re = regex.compile(split)
        self.letters = byte_letters()
        # A word's last symbol carries the mark. As one letter it is the byte's letter moved up by 0x1000.
        letters = sorted(self.letters.values())
        self.vocab: dict[str, int] = model["vocab"]
        self.surface = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # Numbers in order of building: single symbols first, then merges by rank.
        base = [c for c in letters if c in self.vocab] + [c + END for c in letters if c + END in self.vocab]
        number = {t: k for k, t in enumerate(base)}
        self.left, self.right, self.merged = list(range(len(base))), list(range(len(base))), {}
        for a, b in merges:
            if a + b in number:
                raise ValueError(f"{path}: two merges build {a + b!r}")
            number[a + b] = len(self.left)
            self.merged[number[a], number[b]] = len(self.left)
            self.left.append(number[a])
            self.right.append(number[b])
        self.ids = [self.vocab[t] for t in number]
        self.automaton = ahocorasick.Automaton()
        for t, k in number.items():
            word = self.symbols(t)
            self.automaton.add_word(word, (len(word), k))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    @staticmethod
    def symbols(token: str) -> str:
        """One letter a symbol."""
        if token.endswith(END):
            token = token[: -len(END)]
            return token[:-1] + chr(ord(token[-1]) + 0x1000)
        return token

    def compatible(self, a: int, b: int) -> bool:
        """Whether a then b encodes to a then b."""
        key = a << 20 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 200_000:
                self.pairs = {}
            found = self.pairs[key] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        left, right, merged, limit = self.left, self.right, self.merged, 1 << 60
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            undo_a = a > b
            for _ in range(2):
                if undo_a:
                    limit, a = a, right[a]
                    if a != limit:
                        break
                else:
                    limit, b = b + 1, left[b]
                    if b + 1 != limit:
                        break
                undo_a = not undo_a
            else:
                return True

    def word(self, symbols: str) -> list[int]:
        """The ids of one word, given as one letter a symbol."""
        last = [-1] * len(symbols)
        length = [0] * len(symbols)
        pairs, compatible = self.pairs, self.compatible
        for at, (n, token) in self.automaton.iter(symbols):
            if length[at]:
                continue
            before = at - n
            if before < 0 or (last[before] >= 0 and (ok if (ok := pairs.get(last[before] << 20 | token)) is not None else compatible(last[before], token))):
                last[at], length[at] = token, n
        out, at = [], len(symbols) - 1
        while at >= 0:
            if last[at] < 0:
                raise ValueError("no encoding ends here")
            out.append(self.ids[last[at]])
            at -= length[at]
        return out[::-1]

    def chunk(self, text: str) -> list[int]:
        """The ids of any text; special tokens' strings in it are special tokens."""
        ids: list[int] = []
        for part in self.special_re.split(text) if self.special_re else [text]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            # letter by letter, so a capital sigma has one lower case wherever it stands
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for word in self.word_re.findall(part):
                letters = [self.letters[b] for b in word.encode("utf-8")]
                letters[-1] = chr(ord(letters[-1]) + 0x1000)
                ids += self.word("".join(letters))
        return ids

    def encode(self, text: str | None) -> list[int]:
        return [] if not text else [i for c in text.replace("\n", " ").split(" ") if c for i in self.chunk(c)]

    def decode(self, ids) -> str:
        """The tokens' strings with spaces between them: the vocabulary file names no decoder. Unknown ids are left out."""
        return " ".join(self.surface[int(i)] for i in ids if int(i) in self.surface)


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[WordCodec, PieceEncoder]:
    """A vocabulary's codec and its memory of pieces; both last as long as the Python worker."""
    words = WordCodec(path)
    return words, PieceEncoder(lambda pieces: [words.chunk(p) if p else [] for p in pieces], keep=50_000)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and ids (array of int) of every text."""

    def run(batches):
        import pyarrow as pa

        encoder = codec(tokenizer_path)[1]
        for batch in batches:
            for part in slices(batch, "text"):
                ids, ends = encoder.texts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype("i4")))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and decoded text of ids (array of int, null: empty)."""

    def run(batches):
        import pyarrow as pa

        words = codec(tokenizer_path)[0]
        for batch in batches:
            texts = [words.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded string")


def round_trip(docs: DataFrame, tokenizer_path: str, keep_columns: bool = False) -> DataFrame:
    """Encode and decode every text in one pass; digests of both, beside the input's own columns if asked for."""
    codes = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        from hashlib import sha256

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        words, encoder = codec(tokenizer_path)
        surface = pa.array([words.surface.get(i, "") for i in range(max(words.surface) + 1)])
        for batch in batches:
            for part in slices(batch, "text"):
                ids, ends = encoder.texts(part.column("text").to_pylist())
                n, a, b = np.diff(ends), [], []
                decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), surface.take(pa.array(ids))), " ")
                for start, end, text in zip(ends[:-1].tolist(), ends[1:].tolist(), decoded, strict=True):
                    a.append(sha256(ids[start:end]).hexdigest())
                    b.append(sha256(text.as_buffer()).hexdigest())
                kept = part.columns if keep_columns else [part.column("doc_id")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(a), pa.array(b)], [*(part.schema.names if keep_columns else ["doc_id"]), "n_tokens", "ids_sha256", "decoded_sha256"])
        released()

    if keep_columns:
        docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")
        from pyspark.sql import types as T

        schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(codes).fields])
        return docs.mapInArrow(run, schema)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {codes}")
