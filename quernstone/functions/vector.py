"""Vectors as array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    """v by its length; the zero vector stays zero."""
    once = lambda c, use: F.element_at(F.transform(F.array(c), use), 1)  # noqa: E731  a lambda's variable is worked out once
    scaled = lambda u, n: F.transform(u, lambda x: x.cast("double") / F.greatest(n, F.lit(1e-12)))
    return once(v, lambda u: once(F.sqrt(dot(u, u)), lambda n: scaled(u, n)))


def length(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_of(a: Column, b: Column, length_a: Column, length_b: Column) -> Column:
    """cosine, of vectors whose lengths are known."""
    return dot(a, b) / F.greatest(length_a * length_b, F.lit(1e-12))


def cosine(a: Column, b: Column) -> Column:
    return cosine_of(a, b, length(a), length(b))
