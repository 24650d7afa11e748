"""Column expressions over ``array<double>`` vectors; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms below this count as zero.
TINY = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def floored_norm(a: Column) -> Column:
    return F.greatest(norm(a), F.lit(TINY))


def unit(a: Column) -> Column:
    n = floored_norm(a)
    return F.transform(a, lambda x: x / n)


def is_zero(a: Column) -> Column:
    return F.forall(a, lambda x: F.abs(x) < TINY)


def clipped(x: Column) -> Column:
    """To [-1, 1]; NaN becomes -1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.nanvl(x, F.lit(-1.0))))


def cosine(a: Column, b: Column) -> Column:
    """Clipped cosine with floored norms."""
    return clipped(dot(a, b) / (floored_norm(a) * floored_norm(b)))


def plus(a: Column, b: Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def rotated(a: Column, columns: Column) -> Column:
    """The row vector a times a matrix given by its columns, ``array<array<double>>``."""
    return F.transform(columns, lambda c: dot(a, c))
