"""Seeded train/test splits and fixed-size batches."""

from __future__ import annotations

from decimal import ROUND_CEILING, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molspark.functions.hashing import seeded_uniform
from molspark.operators.ranking import hash_cutoff, hash_rank


def train_test_split(df: DataFrame, key, test_size: float = 0.2, seed: int = 42, name: str = "split") -> DataFrame:
    """Mark exactly ``ceil(test_size * n)`` rows as ``test`` and the rest as ``train``.

    The boundary digest is found from the key column; marking rows is then a narrow
    projection, and filters on it are evaluated in the scan stage. Membership depends on
    the key and the seed only. It is not the permutation of any random generator.
    """
    share = Decimal(str(test_size))
    if not 0 <= share <= 1:
        raise ValueError("test_size must be between 0 and 1")
    size = lambda n: int((share * n).to_integral_value(ROUND_CEILING))
    cutoff = hash_cutoff(df, key, size, seed)
    return df.withColumn(name, F.when(cutoff.contains(), "test").otherwise("train"))


def three_way_split(
    df: DataFrame, key, val_size: float = 0.1, test_size: float = 0.2, seed: int = 42, name: str = "split"
) -> DataFrame:
    """Mark exactly ``ceil(test_size * n)`` rows as ``test``, the ``ceil(val_size * n)`` next by
    hash as ``val`` and the rest as ``train``. The test side is that of :func:`train_test_split`."""
    shares = [Decimal(str(s)) for s in (test_size, val_size)]
    if min(shares) < 0 or sum(shares) > 1:
        raise ValueError("the sizes must be shares that add up to one at most")
    whole = lambda share, n: int((share * n).to_integral_value(ROUND_CEILING))
    test = hash_cutoff(df, key, lambda n: whole(shares[0], n), seed)
    both = hash_cutoff(df, key, lambda n: min(n, whole(shares[0], n) + whole(shares[1], n)), seed)
    side = F.when(test.contains(), "test").when(both.contains(), "val").otherwise("train")
    return df.withColumn(name, side)


def threshold_split(df: DataFrame, key, test_size: float = 0.2, seed: int = 42, name: str = "split") -> DataFrame:
    """Split by comparing each row's uniform draw with ``test_size``.

    Sizes are approximate, but no pass over the table is needed and rows keep their side
    when more rows arrive, also in a stream.
    """
    draw = seeded_uniform(key, seed)
    return df.withColumn(name, F.when(draw < F.lit(float(test_size)), "test").otherwise("train"))


def assign_batches(df: DataFrame, key, batch_size: int = 32, seed: int = 42, name: str = "batch_id") -> DataFrame:
    """Give every row a batch number; all batches but the last have ``batch_size`` rows."""
    ranked = hash_rank(df, key, seed, name="_rank")
    batch = F.floor((F.col("_rank") - 1) / F.lit(batch_size)).cast("bigint")
    return ranked.withColumn(name, batch).drop("_rank")
