"""Vector expressions; sums run in element order, so results do not vary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_TOLERANCE = 0.02


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def normalized(vector: Column) -> Column:
    """Unit vector; null for a zero, non-finite or missing one."""
    length = norm(vector)
    usable = (length > 0) & (length < float("inf"))
    return F.when(usable, F.transform(vector, lambda x: x / length))


def truncated(vector: Column, dimension: int) -> Column:
    """Leading part of a vector, brought back to unit length."""
    return F.when(F.size(vector) >= dimension, normalized(F.slice(vector, 1, dimension)))


def all_finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def mean_pooled(hidden: Column, mask: Column) -> Column:
    """Unit mean of the unmasked token vectors in ``array<array<double>>``."""
    kept = F.filter(hidden, lambda _, i: F.get(mask, i) != 0)
    width = F.size(F.get(kept, F.lit(0)))
    sums = F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda column: F.aggregate(kept, F.lit(0.0), lambda acc, row: acc + F.get(row, column)),
    )
    count = F.size(kept)
    return F.when(count > 0, normalized(F.transform(sums, lambda total: total / count)))


def first_token_pooled(hidden: Column) -> Column:
    return normalized(F.get(hidden, F.lit(0)))
