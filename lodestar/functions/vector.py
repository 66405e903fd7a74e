"""Vector functions over arrays of double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to 0..1; 0 if a length differs, or a vector is empty or nearly zero."""
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) >= 1e-10) & (norm(b) >= 1e-10)
    return F.when(usable, F.least(F.greatest(dot(a, b) / (norm(a) * norm(b)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.sqrt(F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column) -> Column:
    """The vector at length 1; unchanged if it is nearly zero."""
    size = norm(a)
    return F.when(size < 1e-10, a).otherwise(F.transform(a, lambda x: x / size))
