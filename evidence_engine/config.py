"""Configuration files: sections of settings, and paths."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

from evidence_engine.operators.fusion import Hybrid
from evidence_engine.operators.lexical import BM25


@dataclass(frozen=True)
class Dense:
    model_name: str = ""
    batch_size: int = 32
    max_seq_length: int = 512
    top_k: int = 5
    normalize_embeddings: bool = True
    passage_prefix: str = "passage: "
    query_prefix: str = "query: "


@dataclass(frozen=True)
class Config:
    lexical: BM25 = field(default_factory=BM25)
    dense: Dense = field(default_factory=Dense)
    hybrid: Hybrid = field(default_factory=Hybrid)
    max_chars: int = 3200
    paths: dict = field(default_factory=dict)


def parsed(text: str) -> dict:
    """A YAML file's sections; without the yaml package, files of two levels of plain settings are understood."""
    try:
        import yaml
    except ImportError:
        pass
    else:
        return yaml.safe_load(text) or {}
    out: dict = {}
    section = out
    for line in text.split("\n"):
        name, colon, value = line.split(" #")[0].partition(":")
        if not colon or name.lstrip().startswith("#"):
            continue
        value = value.strip()
        if not line.startswith(" "):
            section = out if value else out.setdefault(name.strip(), {})
        section[name.strip()] = scalar(value) if value else {}
        if not value:
            section = out[name.strip()] = {}
    return out


def scalar(value: str):
    if value[:1] in "\"'" and value[-1:] == value[:1]:
        return value[1:-1]
    if value in ("true", "false"):
        return value == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def made(kind, settings: dict):
    """A settings object from what a section has of its fields, in the fields' types."""
    types = {f.name: type(f.default) for f in fields(kind)}
    return kind(**{k: types[k](v) for k, v in settings.items() if k in types and v is not None})


def load(path: str) -> Config:
    """Sections bm25, metadata_boost, embedding, retrieval, chunking and paths; what is missing has its default.

    Relative paths are relative to the file's folder.
    """
    raw = parsed(Path(path).read_text(encoding="utf-8"))
    bm25 = raw.get("bm25", {}) | {f"{k}_boost": v for k, v in raw.get("metadata_boost", {}).items()}
    retrieval = raw.get("retrieval", {})
    fusion = {"bm25_top_n": retrieval.get("bm25_top_k"), "vector_top_n": retrieval.get("vector_top_k"), "final_top_k": retrieval.get("final_top_k"), "rrf_k": retrieval.get("rrf_k")}
    dense = raw.get("embedding", {}) | ({"top_k": retrieval["top_k"]} if "top_k" in retrieval else {})
    root = Path(path).resolve().parent
    paths = {k: str(v) if "://" in str(v) else str(root / str(v)) for k, v in raw.get("paths", {}).items()}
    return Config(made(BM25, bm25), made(Dense, dense), made(Hybrid, fusion), int(raw.get("chunking", {}).get("max_chars", 3200)), paths)
