"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def quantised(a: Column) -> tuple[Column, Column]:
    """int8 codes, rounded half away from zero, and their scale: the largest magnitude over 127."""
    scale = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))) / 127
    return F.transform(a, lambda x: F.when(scale == 0, F.lit(0)).otherwise(F.round(x.cast("double") / scale)).cast("int")), scale
