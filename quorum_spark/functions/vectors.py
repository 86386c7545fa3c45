"""Vectors as arrays of doubles, in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column | str) -> Column:
    """v scaled to length 1; its length counts as 1e-12 at least."""
    size = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / size)
