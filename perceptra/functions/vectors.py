"""Column functions over vectors given as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """v / (norm + 1e-9), in double precision."""
    norm = F.sqrt(dot(v, v)) + 1e-9
    return F.transform(v, lambda x: x.cast("double") / norm)
