"""Vector arithmetic as Column expressions: no Python in the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; null if the lengths differ."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if lengths differ, either norm is 0, or the result is undefined."""
    value = dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    value = F.when((F.size(a) != F.size(b)) | (dot(a, a) == 0) | (dot(b, b) == 0), F.lit(0.0)).otherwise(value)
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(value)
