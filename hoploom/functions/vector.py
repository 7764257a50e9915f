"""Vector functions on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _by_length(a: Column, length: Column, of) -> Column:
    """``of(x, length)`` for every x; the length is bound as a one-element array, so it is worked out once a vector."""
    return F.element_at(F.transform(F.array(length), lambda n: F.transform(a, lambda x: of(x, n))), 1)


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    return _by_length(a, norm(a), lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with the small constant on the product of the norms."""
    return dot(a, b) / (norm(a) * norm(b) + EPSILON)


def cosine_each(a: Column, b: Column) -> Column:
    """Cosine with the small constant on each norm."""
    return dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def scaled(a: Column) -> Column:
    """Divided by norm and small constant: the dot product of two such vectors is ``cosine_each``."""
    return _by_length(a, norm(a) + EPSILON, lambda x, n: x.cast("double") / n)
