"""Vector arithmetic on array columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(left: Column, right: Column) -> Column:
    """Dot product of unit vectors, clamped to [0, 1]; 0 if the lengths differ."""
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(left, right)))
    return F.when(F.size(left) != F.size(right), F.lit(0.0)).otherwise(clamped)
