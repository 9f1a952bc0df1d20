"""Vector functions over array columns; sums are doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FACETS = ("poem", "meaning", "keywords")


def as_column(vector: Sequence[float] | Column) -> Column:
    return vector if isinstance(vector, Column) else F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Sequence[float] | Column) -> Column:
    products = F.zip_with(a, as_column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """L2-normalised; a zero vector stays as it is."""
    size = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(size == 0, 1.0).otherwise(size))


def cosine(a: Column, b: Sequence[float] | Column) -> Column:
    """Of vectors that need not be normalised."""
    other = as_column(b)
    return dot(a, other) / (norm(a) * norm(other))


def facet_name(facet: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, FACETS)), (facet + 1).cast("int"))
