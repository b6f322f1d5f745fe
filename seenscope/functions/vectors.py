"""Vector geometry on ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: added to each norm before dividing.
NORM_EPSILON = 1e-8


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def angle(a: Column, b: Column) -> Column:
    """Angle in radians; the cosine is clipped to [-1, 1]."""
    norm_a = F.sqrt(dot(a, a)) + F.lit(NORM_EPSILON)
    norm_b = F.sqrt(dot(b, b)) + F.lit(NORM_EPSILON)
    cosine = dot(a, b) / (norm_a * norm_b)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
