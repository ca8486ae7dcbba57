"""Dense vectors in array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null when either side is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def usable_vector(vector: Column, dim: int) -> Column:
    """Of the right length, without null, NaN or infinite parts, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(vector, lambda x: x == 0)
    return F.coalesce((F.size(vector) == dim) & ~bad & ~zero, F.lit(False))
