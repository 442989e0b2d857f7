"""Joins that replace alignment by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molspark.functions.hashing import as_columns


def _one_row_per_key(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    values = [F.any_value(c).alias(c) for c in df.columns if c not in keys]
    reduced = df.groupBy(*keys).agg(*values, F.count("*").alias("_n"))
    text = F.concat_ws(":", *[c.cast("string") for c in as_columns(keys)])
    message = F.concat(F.lit(f"key occurs more than once on the {side} side: "), text)
    once = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(message).cast("boolean"))
    return reduced.filter(once).drop("_n")


def join_one_to_one(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "exact") -> DataFrame:
    """Equi-join that fails if a key occurs twice on either side or, by default, on one side only.

    It stands in for alignment by position, which loses no row. Any other ``how`` is that of a
    plain join.

    The uniqueness test groups by the join key, so it shares the shuffle of the join, and
    copies of a key are folded before that shuffle instead of being paired.
    """
    keys = [key] if isinstance(key, str) else list(key)
    left, right = _one_row_per_key(left, keys, "left"), _one_row_per_key(right, keys, "right")
    if how != "exact":
        return left.join(right, keys, how)
    joined = left.withColumn("_in_left", F.lit(True)).join(right.withColumn("_in_right", F.lit(True)), keys, "full")
    message = F.concat(F.lit("key occurs on one side only: "), F.concat_ws(":", *[F.col(k).cast("string") for k in keys]))
    matched = F.col("_in_left").isNotNull() & F.col("_in_right").isNotNull()
    return joined.filter(F.when(matched, True).otherwise(F.raise_error(message).cast("boolean"))).drop("_in_left", "_in_right")


def score_registry(df: DataFrame, registry: list[dict], value: Column | None = None) -> DataFrame:
    """Every row with every registry entry, as one narrow pass.

    ``registry`` is a short list of records (a display name, a model name and its
    coefficients). It becomes a literal array that is exploded, so rows are neither shuffled
    nor compared with each other. ``value`` may use the record as column ``model``.
    """
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), *[F.lit(v).alias(k) for k, v in entry.items()])
            for i, entry in enumerate(registry)
        ]
    )
    paired = df.withColumn("model", F.explode(entries))
    return paired if value is None else paired.withColumn("value", value)
