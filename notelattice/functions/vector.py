"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for different lengths or a zero vector, null for a null vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


def store_similarity(cos: Column) -> Column:
    """Similarity of the indexed store, 1 - distance / 2 with distance 1 - cosine: half of 1 + cosine."""
    return (1 + cos) / 2
