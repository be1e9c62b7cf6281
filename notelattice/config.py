"""Settings from the environment, the read-only guard and the ``.env`` loader."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields
from functools import lru_cache

PREFIX = "NOTELATTICE_"
# Kinds of named entities that are kept by default.
ENTITY_TYPES = ("person", "organization", "technology", "concept", "location", "object", "activity", "date_time")


class ReadOnlyError(RuntimeError):
    """A write was tried while the index is read-only."""


@dataclass(frozen=True)
class Settings:
    index_dir: str = "./index"
    embedding_dim: int = 384
    reranker_min_length: int = 20
    reranker_score_threshold: float = -8.0
    max_chunk_tokens: int = 512
    chunk_overlap_tokens: int = 50
    extract_depth: str = "ner"
    ner_entity_types: tuple[str, ...] = ENTITY_TYPES
    default_top_k: int = 10
    fusion_k: int = 60
    graph_rrf_weight: float = 1.5
    rerank_pool_size: int = 20
    semantic_floor: float = 0.4
    snippet_length: int = 300
    graph_max_hops: int = 2
    read_only: bool = False
    embedding_model: str = "hashing"
    ner_model: str = ""
    reranker_model: str = ""
    stop_words_file: str = ""
    skip_upper_file: str = ""


def _parse(kind: str, raw: str, default):
    """A leading number of the text; what can't be read gives the default."""
    if kind == "int":
        m = re.match(r"\s*[+-]?\d+", raw)
        return int(m[0]) if m else default
    if kind == "float":
        m = re.match(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", raw)
        return float(m[0]) if m else default
    if kind == "bool":
        return raw.lower() == "true" or raw == "1"
    if kind.startswith("tuple"):
        return tuple(x.strip() for x in raw.split(",") if x.strip())
    return raw


def load_settings(env: dict[str, str] | None = None) -> Settings:
    """Settings of the variables ``NOTELATTICE_<FIELD>``; unset and empty ones keep the default."""
    env = os.environ if env is None else env
    found = {}
    for f in fields(Settings):
        raw = env.get(PREFIX + f.name.upper())
        if raw:
            found[f.name] = _parse(str(f.type), raw, f.default)
    return Settings(**found)


@lru_cache(maxsize=1)
def get_settings() -> Settings:
    """The settings of this process, read once."""
    return load_settings()


def reset_settings() -> None:
    get_settings.cache_clear()


def assert_writable(operation: str, settings: Settings | None = None) -> None:
    """Raise if the index is read-only."""
    if (settings or get_settings()).read_only:
        raise ReadOnlyError(f"{operation} is not allowed: the index is read-only")


def load_env(path: str = ".env", env: dict[str, str] | None = None) -> dict[str, str]:
    """Add the variables of a file (``KEY=value``, quotes and comments allowed) that are not set yet."""
    env = os.environ if env is None else env
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", line)
                if m and not line.lstrip().startswith("#"):
                    value = m[2]
                    if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                        value = value[1:-1]
                    else:
                        value = re.sub(r"\s+#.*$", "", value)
                    env.setdefault(m[1], value)
    return env
