"""Vector expressions over array columns, summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; what one array has beyond the other doesn't count."""
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def unit(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(_double(a), lambda x: x / size)).otherwise(_double(a))


def max_sim(query: Column, doc: Column) -> Column:
    """Sum over query vectors of the best inner product with a document vector; 0 if either side is empty."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d))))
    return F.when((F.size(query) == 0) | (F.size(doc) == 0), 0.0).otherwise(F.aggregate(best, F.lit(0.0), lambda s, x: s + x))
