"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 for empty vectors, different lengths or a zero norm, null for null."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), _dot(a, b) / F.nullif(norm, F.lit(0.0))).otherwise(F.lit(0.0))
