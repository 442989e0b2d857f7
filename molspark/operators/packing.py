"""Sequences packed into rows of a fixed number of tokens, so that little is padded."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molspark.functions.hashing import seeded_hash
from molspark.operators.ranking import sorted_rank

#: Packs of one composition: (length, how many of it) from the longest on, and the number of packs.
Packs = tuple[tuple[tuple[int, int], ...], int]


def best_fit(counts: Mapping[int, int], budget: int) -> list[Packs]:
    """Best-fit decreasing over a histogram of lengths between 1 and ``budget``.

    The next longest sequence goes to the pack with the least space that takes it, else to a new
    one. Packs with equal contents are handled together, so the work depends on the number of
    different lengths: each adds four compositions at most, whatever the number of sequences.
    """
    packs: dict[int, list[Packs]] = {}
    spaces: list[int] = []  # the keys of packs, ascending

    def put(space: int, items: tuple[tuple[int, int], ...], n: int) -> None:
        if n:
            if space not in packs:
                insort(spaces, space)
            packs.setdefault(space, []).append((items, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                items, n = packs[space].pop(0)
                if not packs[space]:
                    del packs[space], spaces[at]
            else:
                space, items = budget, ()
                n = -(-left // (space // length))
            fit = space // length
            whole = min(n, left // fit)
            put(space - fit * length, (*items, (length, fit)), whole)
            n, left = n - whole, left - whole * fit
            if n and left:  # fewer than one pack takes
                put(space - left * length, (*items, (length, left)), 1)
                n, left = n - 1, 0
            put(space, items, n)
    return [pack for space in sorted(packs) for pack in packs[space]]


def pack_sequences(df: DataFrame, key: str, length: str | Column, budget: int, seed: int = 42) -> DataFrame:
    """``df`` with ``pack_id``, ``pack_offset`` and ``pack_overflow``: sequences placed one after the
    other into packs of at most ``budget`` tokens by :func:`best_fit`.

    Rows are ranked by length, in seeded order among equals, in one range-partitioned pass; a length
    that a third of the rows share is cut at many borders. The driver sees one count per length up to
    ``budget``. A row finds its pack from its rank by binary search in the borders of the compositions,
    at most four per length times the lengths that fit one pack, so nothing is joined.

    A sequence longer than ``budget`` has a pack of its own and ``pack_overflow``. A null or
    non-positive length takes no space: its pack and offset are null. Rows that repeat a key are
    placed each. Columns of the result's names are replaced. An empty table gives an empty one.
    """
    if budget < 1:
        raise ValueError("the budget must be one token at least")
    column = F.col(length) if isinstance(length, str) else length
    rows = df.withColumns({"_len": column.cast("long"), "_digest": seeded_hash(key, seed)}).drop("pack_id", "pack_offset", "pack_overflow")
    ranked = sorted_rank(rows, ["_len", "_digest", key], "_rank")
    shown = F.least(F.greatest(F.coalesce("_len", F.lit(0)), F.lit(0)), F.lit(budget + 1))
    counts = dict(map(tuple, ranked.groupBy(shown.cast("int").alias("_len")).agg(F.count("*")).collect()))
    none, over = counts.pop(0, 0), counts.pop(budget + 1, 0)

    # first rank of each length; null and zero lengths come before
    next_rank, before = {}, none + 1
    for size in sorted(counts):
        next_rank[size], before = before, before + counts[size]
    borders: list[tuple[int, int, int, int, int]] = []
    first_pack = 0
    for items, n in best_fit(counts, budget):
        offset = 0
        for size, m in items:
            borders.append((next_rank[size], first_pack, m, offset, size))
            next_rank[size] += n * m
            offset += size * m
        first_pack += n
    if over:
        borders.append((before, first_pack, 1, 0, 0))
    table = np.array(sorted(borders), np.int64).reshape(-1, 5)

    def place(ranks: pa.Array) -> pa.Array:
        rank = ranks.to_numpy(zero_copy_only=False).astype(np.int64)
        begin, pack, m, offset, size = table[np.maximum(np.searchsorted(table[:, 0], rank, "right") - 1, 0)].T
        which = rank - begin
        return pa.StructArray.from_arrays([pa.array(pack + which // m), pa.array(offset + which % m * size)], ["pack_id", "pack_offset"])

    if not borders:
        spot = F.lit(None).cast("struct<pack_id: bigint, pack_offset: bigint>")
    else:
        spot = F.when(F.col("_rank") > none, F.arrow_udf(place, "struct<pack_id: bigint, pack_offset: bigint>")("_rank"))
    placed = ranked.withColumn("_spot", spot)
    return placed.withColumns(
        {
            "pack_id": F.col("_spot.pack_id"),
            "pack_offset": F.col("_spot.pack_offset"),
            "pack_overflow": F.coalesce(F.col("_len") > budget, F.lit(False)),
        }
    ).drop("_spot", "_rank", "_len", "_digest")


def packing_waste(df: DataFrame, length: str | Column, budget: int) -> DataFrame:
    """How many packs hold how many tokens, and the share of pad positions in them."""
    column = F.col(length) if isinstance(length, str) else length
    used = df.where("pack_id is not null and not pack_overflow").groupBy("pack_id").agg(F.sum(column).alias("n_tokens"))
    filled = used.groupBy("n_tokens").agg(F.count("*").alias("n_packs"))
    return filled.withColumn("waste", 1 - F.col("n_tokens") / F.lit(budget))


def packing_check(df: DataFrame, length: str | Column, budget: int) -> DataFrame:
    """One row: rows, rows with a place, packs, and places that lie beyond the budget or do not begin
    where the place before them ends. A pack has ``budget`` rows at most, which bounds the window."""
    column = F.col(length) if isinstance(length, str) else length
    spots = df.select("pack_id", "pack_offset", "pack_overflow", column.cast("long").alias("_len"))
    placed = spots.where("pack_id is not null")
    ends = F.lag(F.col("pack_offset") + F.col("_len"), 1, 0).over(Window.partitionBy("pack_id").orderBy("pack_offset"))
    checked = placed.withColumn("_begin", ends).agg(
        F.count("*").alias("n_placed"),
        F.count_if(~F.col("pack_overflow") & (F.col("pack_offset") + F.col("_len") > budget)).alias("n_beyond"),
        F.count_if(F.col("pack_offset") != F.col("_begin")).alias("n_misplaced"),
    )
    return df.agg(F.count("*").alias("n_rows")).crossJoin(checked)  # tables of one row
