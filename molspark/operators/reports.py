"""Regression reports, parity tables and dataset profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molspark.functions import metrics as M
from molspark.operators.checks import require_columns


def _metric_columns(y: str, y_pred: str) -> list[Column]:
    a, b = F.col(y), F.col(y_pred)
    return [
        M.pair_count(a, b).alias("n"),
        M.mae(a, b).alias("mae"),
        M.mse(a, b).alias("mse"),
        M.rmse(a, b).alias("rmse"),
        M.r2(a, b).alias("r2"),
    ]


def regression_report(df: DataFrame, y: str = "y", y_pred: str = "y_pred") -> DataFrame:
    """n, MAE, MSE, RMSE and R2 over a whole table, in one pass."""
    return df.agg(*_metric_columns(y, y_pred))


def regression_report_by(
    df: DataFrame, by: str | list[str], y: str = "y", y_pred: str = "y_pred", total: bool = False
) -> DataFrame:
    """The same per group.

    ``total`` adds subtotals and the grand total as null groups; ``level`` is 0 for the
    groups themselves, so a total is not mistaken for a group whose key is null.
    """
    keys = [by] if isinstance(by, str) else by
    if not total:
        return df.groupBy(*keys).agg(*_metric_columns(y, y_pred))
    return df.rollup(*keys).agg(F.grouping_id().cast("int").alias("level"), *_metric_columns(y, y_pred))


def masked_loss(df: DataFrame, label: str, y_pred: str) -> DataFrame:
    """Mean squared error over labelled rows only, with labelled and unlabelled counts."""
    a, b = F.col(label), F.col(y_pred)
    return df.agg(
        F.count("*").alias("n_rows"),
        M.pair_count(a, b).alias("n_labelled"),
        M.mse(a, b).alias("mse"),
    )


def parity_table(df: DataFrame, key: str, y: str = "y", y_pred: str = "y_pred") -> DataFrame:
    """(key, actual, predicted, residual) per row."""
    return df.select(
        key,
        F.col(y).cast("double").alias("actual"),
        F.col(y_pred).cast("double").alias("predicted"),
        M.residual(F.col(y), F.col(y_pred)).alias("residual"),
    )


def parity_histogram(df: DataFrame, bins: int = 50, y: str = "y", y_pred: str = "y_pred") -> DataFrame:
    """Two-dimensional histogram of actual against predicted on one square grid.

    Stays at ``bins`` squared rows however many points there are. The grid bounds are a
    scalar subquery over the same two columns; the top edge belongs to the last bin.
    """
    pairs = df.select(F.col(y).cast("double").alias("_y"), F.col(y_pred).cast("double").alias("_p")).filter(
        "_y IS NOT NULL AND _p IS NOT NULL"
    )
    low, high = F.least(F.min("_y"), F.min("_p")), F.greatest(F.max("_y"), F.max("_p"))
    bounds = pairs.agg(F.struct(low.alias("low"), ((high - low) / bins).alias("width")).alias("b"))

    def cell(value: str) -> Column:
        step = F.nullif(F.col("_b.width"), F.lit(0.0))
        position = F.floor((F.col(value) - F.col("_b.low")) / step).cast("int")
        return F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1))

    return (
        pairs.withColumn("_b", bounds.scalar())
        .groupBy(cell("_y").alias("actual_bin"), cell("_p").alias("predicted_bin"))
        .agg(F.count("*").alias("n"), F.avg(F.abs(F.col("_p") - F.col("_y"))).alias("mean_residual"))
    )


def epoch_losses(df: DataFrame, run: str, epoch: str | Column, sq_err: str | Column) -> DataFrame:
    """(run, epoch, eval_loss): mean squared error per run and epoch."""
    epoch = F.col(epoch) if isinstance(epoch, str) else epoch
    sq_err = F.col(sq_err) if isinstance(sq_err, str) else sq_err
    return df.groupBy(F.col(run).alias("run"), epoch.alias("epoch")).agg(
        F.avg(sq_err).alias("eval_loss"), F.count(sq_err).alias("n")
    )


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename, raising on an absent source or a taken target."""
    require_columns(df, [old])
    if new != old and new in df.columns:
        raise ValueError(f"column {new} already exists")
    return df.withColumnRenamed(old, new)


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    require_columns(df, columns)
    return df.select(*columns)


def dataset_profile(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """One row per column: type, rows, nulls, distinct values, and numeric range.

    A single aggregation over the table. Distinct counts are sketches unless ``exact``.
    """
    columns = columns or df.columns
    require_columns(df, columns)
    distinct = F.count_distinct if exact else F.approx_count_distinct
    kinds = {f.name: f.dataType for f in df.schema.fields}
    stats = [F.count("*").alias("_rows")]
    for i, name in enumerate(columns):
        number = F.col(name).cast("double") if isinstance(kinds[name], T.NumericType) else F.lit(None).cast("double")
        stats += [
            F.count(name).alias(f"_filled_{i}"),
            distinct(F.col(name)).alias(f"_distinct_{i}"),
            F.min(number).alias(f"_min_{i}"),
            F.max(number).alias(f"_max_{i}"),
        ]
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(kinds[name].simpleString()).alias("type"),
            F.col("_rows").alias("n_rows"),
            (F.col("_rows") - F.col(f"_filled_{i}")).alias("n_null"),
            F.col(f"_distinct_{i}").alias("n_distinct"),
            F.col(f"_min_{i}").alias("min_value"),
            F.col(f"_max_{i}").alias("max_value"),
        )
        for i, name in enumerate(columns)
    ]
    return df.agg(*stats).select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by key; a top-k, not a sort of the table. ``n`` should be small."""
    return df.orderBy(key).limit(n)
