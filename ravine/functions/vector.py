"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _double(x: Column) -> Column:
    return x.cast("double")


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: _double(x) * _double(y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 where lengths differ, null for a zero vector or null."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(F.try_divide(dot(a, b), norm))


def cosine_to(a: Column, query: list[float]) -> Column:
    """``cosine`` against a constant, whose norm is worked out once."""
    norm = sum(float(x) * float(x) for x in query) ** 0.5
    return F.when(F.size(a) != len(query), F.lit(0.0)).otherwise(F.try_divide(dot(a, literal(query)), F.sqrt(dot(a, a)) * F.lit(norm)))
