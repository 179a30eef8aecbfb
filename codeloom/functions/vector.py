"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _array(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column | str, b: Column | str | list[float]) -> Column:
    """1 less the cosine of the angle; null where either vector is zero."""
    x = F.col(a) if isinstance(a, str) else a
    y = _array(b) if isinstance(b, list) else F.col(b) if isinstance(b, str) else b
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.lit(1.0) - dot(x, y) / F.nullif(norm, F.lit(0.0))
