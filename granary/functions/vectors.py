"""Vector expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """In -1..1; 0 where a vector is missing, empty, zero or of another length."""
    size = norm(a) * norm(b)
    fits = (F.size(a) == F.size(b)) & (size > 0)
    return F.coalesce(F.when(fits, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(size, F.lit(0.0))))), F.lit(0.0))


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def atan_normalised(x: Column) -> Column:
    return F.lit(2.0) / F.pi() * F.atan(x)
