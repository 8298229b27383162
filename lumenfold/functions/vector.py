"""Vector expressions on array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit vector; zero, null or non-finite components are an error."""
    size = norm(a)
    fine = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x)) & (size > 0) & (size < float("inf"))
    return F.when(fine, F.transform(a, lambda x: x / size)).otherwise(F.raise_error(F.lit("vector without direction")))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine, within [0, 2]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b) / (norm(a) * norm(b))))
