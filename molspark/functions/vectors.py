"""Expressions over ``array<float>`` / ``array<double>`` vector columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def pool_first(hidden: Column) -> Column:
    """Vector of the first token of an ``array<array<float>>`` encoder output."""
    return F.try_element_at(hidden, F.lit(1))


def dot(vector: Column, weights: Sequence[float], intercept: float = 0.0) -> Column:
    """``intercept + sum(vector[i] * weights[i])`` in double precision, left to right.

    A null vector, or one of another length, gives null.
    """
    literal = F.array(*[F.lit(float(w)) for w in weights])
    total = F.aggregate(
        F.zip_with(vector, literal, lambda x, w: x.cast("double") * w),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return F.when(F.size(vector) == len(weights), total + F.lit(float(intercept)))


def linear(columns: Sequence[Column], weights: Sequence[float], intercept: float = 0.0) -> Column:
    """The same over separate feature columns; compiles to plain arithmetic."""
    value = F.lit(float(intercept))
    for column, weight in zip(columns, weights, strict=True):
        value = value + column.cast("double") * F.lit(float(weight))
    return value
