"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, in index order; 0 for vectors of different lengths."""
    products = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), products).when(a.isNotNull() & b.isNotNull(), F.lit(0.0))


def length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """v scaled to length 1; null for a zero vector."""
    of = length(v)
    return F.when(of > 0, F.transform(v, lambda x: x.cast("double") / of))
