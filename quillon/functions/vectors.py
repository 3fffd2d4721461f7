"""Vectors as columns: all arithmetic in double precision, whatever the stored type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, epsilon: float = 1e-9) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + epsilon)


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def distance(kind: str, a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    match kind:
        case "cosine":
            return 1 - dot(a, b) / (norm(a) * norm(b))
        case "L1":
            return _sum(gaps)
        case "L2":
            return F.sqrt(_sum(F.transform(gaps, lambda x: x * x)))
        case "Linf":
            return F.array_max(gaps)
    raise ValueError(f"no distance named {kind}")


def is_sound(v: Column, dim: int) -> Column:
    """Of the right length and finite throughout."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def checked(v: Column, dim: int) -> Column:
    return F.when(is_sound(v, dim), v).otherwise(F.raise_error(F.lit(f"not a finite vector of {dim} numbers")).cast("array<float>"))
