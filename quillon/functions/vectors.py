"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for null vectors, vectors of different lengths and zero vectors."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def vector(values: Sequence[float]) -> Column:
    """A literal vector: no join is needed to score a table against it."""
    return F.array(*[F.lit(float(v)) for v in values])


def sparse_sorted(weights: Column) -> Column:
    """A map of index to weight as array<struct<index,value>> in order of the index."""
    return F.array_sort(F.transform(F.map_entries(weights), lambda e: F.struct(e["key"].cast("long").alias("index"), e["value"].cast("double").alias("value"))))
