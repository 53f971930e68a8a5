"""Vector columns in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """``v`` with length one; null for the zero vector."""
    length = F.nullif(norm(v), F.lit(0.0))
    return F.get(F.transform(F.array(length), lambda n: F.when(n.isNotNull(), F.transform(v, lambda x: x / n))), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where either is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
