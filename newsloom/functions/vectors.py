"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """0 for different lengths or a zero vector. Norms are taken once per row, not per pair."""
    return F.when((F.size(a) == F.size(b)) & (norm_a > 0) & (norm_b > 0), dot(a, b) / (norm_a * norm_b)).otherwise(0.0)
