"""Model hooks: embedder, named entities and reranker, each a function over a batch of texts.

A hook is any picklable callable; it is made once per worker by its factory. The defaults need no
weights: the embedder hashes tokens into signed buckets, named entities and the reranker are absent,
and absence has a defined result (no entities; scores by position).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[list[str]], list[list[float] | None]]
Recogniser = Callable[[list[str]], list[list[tuple[str, str]]]]
Reranker = Callable[[list[str], list[str]], list[float | None]]

_HOOKS: dict[str, object] = {}


def set_hook(kind: str, model: object) -> None:
    """The model of a kind (``embedder``, ``recogniser`` or ``reranker``) where a call names none."""
    if kind not in ("embedder", "recogniser", "reranker"):
        raise ValueError(f"no hook of kind {kind}")
    _HOOKS[kind] = model


def get_hook(kind: str):
    """The model set for a kind, or null."""
    return _HOOKS.get(kind)


def reset_hooks() -> None:
    """Forget all models that were set."""
    _HOOKS.clear()


# Entity groups of common recognisers.
LABELS = {
    "PER": "person", "PERSON": "person", "ORG": "organization", "ORGANIZATION": "organization", "LOC": "location", "LOCATION": "location", "MISC": "concept",
}


def hashing_embedder(dim: int = 384) -> Embedder:
    """Signed feature hashing of lower-cased words, of unit length; a text without words gives null."""

    def embed(texts: list[str]) -> list[list[float] | None]:
        places: dict[str, tuple[int, float]] = {}  # each word of a batch is hashed once
        out: list[list[float] | None] = []
        for text in texts:
            v = [0.0] * dim
            for word, n in Counter(re.findall(r"\w+", (text or "").lower())).items():
                if word not in places:
                    h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
                    places[word] = h % dim, 1.0 if (h >> 62) & 1 else -1.0
                at, sign = places[word]
                v[at] += sign * n
            norm = math.sqrt(sum(x * x for x in v))
            out.append([x / norm for x in v] if norm else None)
        return out

    return embed


def embed(text: Column, model: Embedder) -> Column:
    """Embeddings over Arrow batches; what the model can't embed is null."""

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(model([t or "" for t in batch]), dtype=object)

    return run(text)


def _each(model: Callable[..., list], *columns: list, missing: object) -> list:
    """Results of a batch; where the model fails at it, item by item, ``missing`` for those that fail."""
    try:
        found = list(model(*columns))
        if len(found) == len(columns[0]):
            return found
    except Exception:  # noqa: BLE001 - only the failing items are lost
        pass
    if len(columns[0]) == 1:
        return [missing]
    return [x for item in zip(*columns) for x in _each(model, *[[c] for c in item], missing=missing)]


def named_entities(df: DataFrame, key: str, text: str, model: Recogniser | None, types: tuple[str, ...]) -> DataFrame:
    """Rows (key, ord, type, name), distinct per key; labels are mapped, unknown ones are ``concept``.

    Without a model, and for texts at which it fails, there are no entities.
    """
    schema = T.StructType([df.schema[key], T.StructField("ord", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("name", T.StringType())])
    if model is None:
        return df.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            found = _each(model, [t or "" for t in batch.column(1).to_pylist()], missing=[])
            for k, entities in zip(batch.column(0).to_pylist(), found):
                named = [(LABELS.get(label, "concept"), name.strip()) for label, name in entities]
                for i, (kind, name) in enumerate(dict.fromkeys(n for n in named if n[0] in types and n[1])):
                    rows.append((k, i, kind, name))
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.int32(), pa.string(), pa.string()))], names=schema.fieldNames())

    return df.select(key, text).mapInArrow(run, schema)


def rerank_scores(query: Column, text: Column, model: Reranker) -> Column:
    """Scores of (query, first 512 characters of the text), the model's input window; null where it fails."""

    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(_each(model, list(queries), [(t or "")[:512] for t in texts], missing=None), dtype="float64")

    return run(query, text)
