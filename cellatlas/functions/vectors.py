"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Summed in double, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column, guard: float | None = None) -> Column:
    """a at length 1: with a guard it is added to the length, else a zero vector stays as it is."""
    length = F.when(norm(a) == 0, F.lit(1.0)).otherwise(norm(a)) if guard is None else norm(a) + F.lit(guard)
    return F.transform(F.array(length), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def cosine(a: Column, b: Column, guard: float = 1e-8) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(guard))


def mixed(a: Column, b: Column, alpha: float) -> Column:
    """alpha * a + (1 - alpha) * b."""
    return F.zip_with(a, b, lambda x, y: F.lit(alpha) * x.cast("double") + F.lit(1 - alpha) * y.cast("double"))


def padded(a: Column, length: int, fill: Column) -> Column:
    """a, cut or filled up to `length`."""
    return F.concat(F.slice(a, 1, length), F.array_repeat(fill, F.greatest(F.lit(length) - F.size(a), F.lit(0))))


def binned(v: Column, bins: int) -> Column:
    """Whole part of v, at most bins - 1."""
    return F.least(v.cast("int"), F.lit(bins - 1))


def clipped_scale(v: Column, mean: Column, std: Column, most: float = 10.0) -> Column:
    """(v - mean) / std, a zero std counting as 1, at most `most`."""
    return F.least((v - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std), F.lit(most))
