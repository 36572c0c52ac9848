"""Distances between array columns, inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine; a vector of length zero is at distance 1 from everything."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / norms)


METRICS: dict[str, Callable[[Column, Column], Column]] = {"l2": l2, "cosine": cosine}


def doubles(a: Column) -> Column:
    return a.cast("array<double>")
