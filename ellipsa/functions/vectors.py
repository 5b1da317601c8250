"""Vector expressions: arrays of doubles in, Spark columns out. Higher-order functions run in the JVM, but outside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    """Elements as doubles, before any arithmetic."""
    return vector.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_norm(a: Column) -> Column:
    return total(F.transform(a, lambda x: x * x))


def uniform(key: Column, seed: int | str) -> Column:
    """U[0, 1) from the key and a seed by md5: the same number in every run and every partitioning."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
