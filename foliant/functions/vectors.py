"""Vector functions on ``array<float>`` columns, summed up in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _pairs(a: Column, b: Column, fn) -> Column:
    return F.zip_with(a, b, lambda x, y: fn(x.cast("double"), y.cast("double")))


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products (V2)."""
    return _sum(_pairs(a, b, lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, the value a flat L2 index returns (V3)."""
    return _sum(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance (V3)."""
    return F.sqrt(l2_squared(a, b))


def l2_norm(a: Column) -> Column:
    """Euclidean length (V6)."""
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Inner product over the norms; NULL where one of them is zero (V6)."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms > 0, inner_product(a, b) / norms)


def truncate(a: Column, dim: int, renormalise: bool = False) -> Column:
    """The first ``dim`` components, optionally scaled back to unit length (V1)."""
    cut = F.slice(a, 1, dim)
    if not renormalise:
        return cut
    norm = l2_norm(cut)
    return F.when(
        norm > 0, F.transform(cut, lambda x: (x.cast("double") / norm).cast("float"))
    ).otherwise(cut)


def is_embedded(a: Column) -> Column:
    """A non-empty embedding."""
    return F.coalesce(F.size(a) > 0, F.lit(False))
