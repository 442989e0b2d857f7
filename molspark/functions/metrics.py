"""Regression metrics as aggregate expressions; rows with a null on either side are skipped.

All of them are one-pass and algebraic, so Spark combines them per task before the
shuffle and a group that holds most of the rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def residual(y: Column, y_pred: Column) -> Column:
    return F.abs(y_pred.cast("double") - y.cast("double"))


def squared_error(y: Column, y_pred: Column) -> Column:
    error = y_pred.cast("double") - y.cast("double")
    return error * error


def pair_count(y: Column, y_pred: Column) -> Column:
    return F.count(squared_error(y, y_pred))


def mae(y: Column, y_pred: Column) -> Column:
    return F.avg(residual(y, y_pred))


def mse(y: Column, y_pred: Column) -> Column:
    return F.avg(squared_error(y, y_pred))


def rmse(y: Column, y_pred: Column) -> Column:
    return F.sqrt(mse(y, y_pred))


def r2(y: Column, y_pred: Column) -> Column:
    """Coefficient of determination 1 - SSres / SStot; null when the label is constant."""
    both = F.when(y_pred.isNotNull(), y.cast("double"))
    total = F.count(both) * F.var_pop(both)
    return 1 - F.sum(squared_error(y, y_pred)) / F.nullif(total, F.lit(0.0))
