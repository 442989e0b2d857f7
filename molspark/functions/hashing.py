"""Seeded, reproducible hashes and uniform draws from key columns.

md5 is used because every engine computes the same digest, so a split or a draw can be
checked elsewhere; the same row gets the same value under any partitioning or retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits are 52 bits, which a double holds exactly.
_UNIFORM_DIGITS = 13


def as_columns(keys: str | Column | Sequence[str | Column]) -> list[Column]:
    if isinstance(keys, (str, Column)):
        keys = [keys]
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def _part(column: Column, alone: bool) -> Column:
    text = column.cast("string")
    if not alone:
        text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))
    return F.coalesce(text, F.lit("\\N"))


def seeded_hash(keys, seed: int | str = 42) -> Column:
    """32 hex digits of ``md5(seed:key1:key2...)``.

    In a key of several columns ``:`` and the backslash are escaped, and a null is ``\\N``, so
    different keys are different texts.
    """
    columns = as_columns(keys)
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_part(c, len(columns) == 1) for c in columns]))


def hash_uniform(digest: Column) -> Column:
    """Map a hex digest to a double in [0, 1)."""
    head = F.substring(digest, 1, _UNIFORM_DIGITS)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(float(2 ** (4 * _UNIFORM_DIGITS)))


def seeded_uniform(keys, seed: int | str = 42) -> Column:
    return hash_uniform(seeded_hash(keys, seed))


def content_key(columns) -> Column:
    """Key made of a row's content, for tables without one. Equal rows share it."""
    parts = [F.coalesce(c.cast("string"), F.lit("\u0000")) for c in as_columns(columns)]
    return F.md5(F.concat_ws("\u0001", *parts))
