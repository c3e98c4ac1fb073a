"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column, left_norm: Column | None = None, right_norm: Column | None = None) -> Column:
    """Cosine, 0 where a vector is missing, zero or of another width."""
    a = norm(left) if left_norm is None else left_norm
    b = norm(right) if right_norm is None else right_norm
    fits = (F.size(left) == F.size(right)) & (F.size(left) > 0) & (a > 0) & (b > 0)
    return F.when(F.coalesce(fits, F.lit(False)), dot(left, right) / (a * b)).otherwise(F.lit(0.0))
