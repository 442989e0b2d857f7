"""Data-quality checks. Each is one aggregation with map-side combine, no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molspark.functions.hashing import as_columns


def require_columns(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def duplicate_keys(df: DataFrame, key) -> DataFrame:
    """Keys that occur more than once, with their number of rows as ``n_rows``."""
    columns = as_columns(key)
    return df.groupBy(*columns).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def assert_unique(df: DataFrame, key) -> DataFrame:
    """Return ``df`` unchanged, or raise if a key occurs twice (starts one job)."""
    worst = duplicate_keys(df, key).first()
    if worst is not None:
        raise ValueError(f"key {key} is not unique, for example {worst.asDict()}")
    return df


def split_partition_check(df: DataFrame, parts: DataFrame, key, split: str = "split") -> DataFrame:
    """Compare the rows of ``parts`` with those of ``df``, key by key.

    One row: how many keys are missing from the parts, added, repeated, or in both sides.
    Each side is reduced to counts per key before the shuffle.
    """
    names = [c for c in ([key] if isinstance(key, str) else key)]
    whole = df.select(*names, F.lit(1).alias("_whole"), F.lit(0).alias("_train"), F.lit(0).alias("_test"))
    sides = parts.select(
        *names,
        F.lit(0).alias("_whole"),
        (F.col(split) == "train").cast("int").alias("_train"),
        (F.col(split) == "test").cast("int").alias("_test"),
    )
    per_key = whole.unionByName(sides).groupBy(*names).agg(
        F.sum("_whole").alias("_whole"), F.sum("_train").alias("_train"), F.sum("_test").alias("_test")
    )
    placed = F.col("_train") + F.col("_test")
    return per_key.agg(
        F.coalesce(F.sum("_whole"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("_train"), F.lit(0)).alias("n_train"),
        F.coalesce(F.sum("_test"), F.lit(0)).alias("n_test"),
        F.count_if(placed < F.col("_whole")).alias("missing_keys"),
        F.count_if(placed > F.col("_whole")).alias("extra_keys"),
        F.count_if((F.col("_train") > 0) & (F.col("_test") > 0)).alias("shared_keys"),
    )


def split_overlap(df: DataFrame, value: str | Column, split: str = "split") -> DataFrame:
    """How many distinct values, and rows, of a column occur on both sides of a split.

    Grouped by value instead of joined, so a value that fills a third of the table is
    counted before the shuffle and never paired with itself.
    """
    (column,) = as_columns(value)
    per_value = df.groupBy(column.alias("_value")).agg(
        F.count_if(F.col(split) == "train").alias("_train"),
        F.count_if(F.col(split) == "test").alias("_test"),
    )
    shared = F.col("_value").isNotNull() & (F.col("_train") > 0) & (F.col("_test") > 0)
    return per_value.agg(
        F.count("_value").alias("n_values"),
        F.count_if(shared).alias("shared_values"),
        F.coalesce(F.sum(F.when(shared, F.col("_train"))), F.lit(0)).alias("shared_train_rows"),
        F.coalesce(F.sum(F.when(shared, F.col("_test"))), F.lit(0)).alias("shared_test_rows"),
    )


def shared_values(df: DataFrame, value: str, split: str = "split") -> DataFrame:
    """The values behind :func:`split_overlap`, with their row counts on each side."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(value)
        .agg(
            F.count_if(F.col(split) == "train").alias("train_rows"),
            F.count_if(F.col(split) == "test").alias("test_rows"),
        )
        .filter("train_rows > 0 AND test_rows > 0")
    )


def rows_in_both(left: DataFrame, right: DataFrame, key) -> DataFrame:
    """One row: the keys of two subsets, and how many they share.

    Shows, for example, that the rows which chose a model also report on it.
    """
    names = [key] if isinstance(key, str) else list(key)
    sides = left.select(*names, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        right.select(*names, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    per_key = sides.groupBy(*names).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return per_key.agg(
        F.count_if(F.col("_a") == 1).alias("n_left"),
        F.count_if(F.col("_b") == 1).alias("n_right"),
        F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("n_shared"),
    )
