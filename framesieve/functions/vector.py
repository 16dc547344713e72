"""Vectors as array columns, computed in DOUBLE from left to right."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column, floor: float = 0.0) -> Column:
    """Unit vector; a zero vector is an error unless the norm has a floor."""
    n = F.greatest(norm(a), F.lit(floor)) if floor else F.when(norm(a) == 0, F.raise_error(F.lit("zero-norm vector"))).otherwise(norm(a))
    return F.transform(a.cast("array<double>"), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in width")).cast("double"))
    return same.otherwise(dot(a, b) / (norm(a) * norm(b)))


def combined(a: Column, b: Column, weight_a: float = 0.2, weight_b: float = 0.8) -> Column:
    """Unit vector of a weighted sum: a query and its translation."""
    return normalized(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: weight_a * x + weight_b * y), 1e-12)
