"""Splits that keep rows with common values together.

Rows that share a value in any of the given columns are one group, and so are rows linked through
others. A split that places whole groups leaves no value on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molspark.functions.hashing import as_columns, seeded_hash
from molspark.operators.ranking import sorted_rank
from molspark.session import materialize

#: Sums up to this many rows are searched exactly for the nearest reachable size.
EXACT_ROWS = 1 << 24


def _flat(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, parent), by doubling: each pass halves every path. Names are
    digests, so that paths towards ever smaller names are short."""
    parents = materialize(parents, "parents")
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        doubled = materialize(parents.join(above, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "parents")
        parents = doubled.drop("moved")
        if doubled.where("moved").isEmpty():
            return parents.withColumnRenamed("parent", "root")


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); equal roots are connected nodes.

    Each round every node joins its least neighbour if that is less than itself, trees are merged into
    their roots, and the links between different roots remain. At least half the nodes with a link
    vanish in a round. A node of many links is counted per task, and its links fall together in the
    next round."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = materialize(both.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    links = materialize(links.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        roots = _flat(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("parent")))
        first = roots.select(F.col("node").alias("u"), F.col("root").alias("a"))
        second = roots.select(F.col("node").alias("v"), F.col("root").alias("b"))
        merged = links.join(first, "u").join(second, "v").where("a != b")
        links = materialize(merged.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
        step = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = materialize(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
    return labels


def linked_groups(df: DataFrame, key: str, values: Sequence[str | Column]) -> DataFrame:
    """``df`` with ``group_id``, the least key of the row's group, and ``group_rows``, its size.

    A null value links nothing; a row of nulls only is a group of its own, and so is a row that shares
    no value. ``key`` should identify a row; rows that repeat a key are counted each. Values of
    different columns are different even if they look alike. The links are between values, one per
    value and row, so the rows of a hot value are not paired; the rows themselves move once, to be
    joined with the groups by their first value."""
    names = [F.md5(F.concat(F.lit(f"{i}:"), column.cast("string"))) for i, column in enumerate(as_columns(list(values)))]
    rows = df.withColumn("_values", F.array_compact(F.array(*names))).withColumn("_first", F.array_min("_values"))
    linked = rows.select(F.col(key).alias("_key"), "_values", "_first").where("_first is not null")
    links = linked.select(F.explode("_values").alias("u"), F.col("_first").alias("v")).distinct()
    roots = connected(links).withColumnRenamed("node", "_first")
    counted = linked.groupBy("_first").agg(F.min("_key").alias("least"), F.count("*").alias("n")).join(roots, "_first")
    groups = counted.groupBy("root").agg(F.min("least").alias("group_id"), F.sum("n").alias("group_rows"))
    groups = materialize(counted.select("_first", "root").join(groups, "root").select("_first", "group_id", "group_rows"), "groups")
    kept = [F.col(name) for name in df.columns if name not in ("group_id", "group_rows")]
    return rows.drop("group_id", "group_rows").join(groups, "_first", "left").select(
        *kept, F.when(F.col("_first").isNull(), F.col(key)).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("group_rows", F.lit(1)).alias("group_rows")
    )


def nearest_sizes(sizes: dict[int, int], target: int, exact: int = EXACT_ROWS) -> dict[int, int]:
    """How many groups of each size to take so that they hold as nearly ``target`` rows as can be.

    ``sizes`` counts the groups of a size. The reachable sums are built group by group, powers of two
    of equal groups at a time; each sum remembers the first step that reached it, which leads back to
    the groups. Of two sums equally near the smaller one is taken. Beyond ``exact`` rows the largest
    groups that fit are taken first, until the rest can be searched; the result is then within the
    smallest group of the best one where groups that small abound."""
    taken: dict[int, int] = {}
    for size in sorted(sizes, reverse=True):
        if target <= exact:
            break
        n = min(sizes[size], (target - exact // 2) // size) if size < target else 0
        taken[size], target = max(n, 0), target - max(n, 0) * size
    left = {size: n - taken.get(size, 0) for size, n in sizes.items() if n > taken.get(size, 0)}
    # a sum above the target can only be nearest if it exceeds it by less than the target
    limit = min(2 * target, sum(size * n for size, n in left.items()))
    steps: list[tuple[int, int]] = []
    for size, n in sorted(left.items(), reverse=True):
        power = 1
        while n > 0 and size <= limit:
            steps.append((size, min(power, n)))
            n, power = n - power, power * 2
    reached = np.full(limit + 1, -1, np.int32)
    reached[0] = len(steps)
    for k, (size, n) in enumerate(steps):
        weight = size * n
        if weight <= limit:
            fresh = (reached[weight:] < 0) & (reached[: limit + 1 - weight] >= 0)
            # sums reached by this very step do not count: numpy looks before it writes
            reached[weight:][fresh] = k
    sums = np.flatnonzero(reached >= 0)
    total = int(sums[np.argmin(np.abs(sums - target))])
    while total:
        size, n = steps[reached[total]]
        taken[size] = taken.get(size, 0) + n
        total -= size * n
    return {size: n for size, n in taken.items() if n}


def grouped_split(df: DataFrame, key: str, values: Sequence[str | Column], test_size: float = 0.2, seed: int = 42, name: str = "split") -> DataFrame:
    """``df`` with ``group_id``, ``group_rows`` and ``name``, ``test`` or ``train``: whole groups of
    linked rows (:func:`linked_groups`), so that no value is on both sides and the test side is as near
    ``test_size`` of the rows as the sizes of the groups allow.

    What reaches the driver is the number of groups of each size; there are at most sqrt(2 n) sizes of
    n rows. Of the groups of one size, those with the least seeded hash are taken. An empty table gives
    an empty one."""
    share = Decimal(str(test_size))
    if not 0 <= share <= 1:
        raise ValueError("test_size must be between 0 and 1")
    rows = materialize(linked_groups(df, key, values), "linked")
    groups = rows.groupBy("group_id").agg(F.count("*").alias("n"))
    histogram = dict(map(tuple, groups.groupBy("n").agg(F.count("*")).collect()))
    n_rows = sum(size * n for size, n in histogram.items())
    taken = nearest_sizes(histogram, int((share * n_rows).to_integral_value(ROUND_HALF_EVEN)))
    # ranks among the groups of all sizes that are taken from, smaller sizes first
    begins, before = [], 0
    for size in sorted(taken):
        begins.append((size, before, taken[size]))
        before += histogram[size]
    bounds = df.sparkSession.createDataFrame(begins, "n long, _begin long, _take long")
    ranked = sorted_rank(groups.join(bounds, "n").withColumn("_digest", seeded_hash("group_id", seed)), ["n", "_digest", "group_id"], "_rank")
    chosen = ranked.where(F.col("_rank") - F.col("_begin") <= F.col("_take"))
    chosen = materialize(chosen.select(F.struct("group_id").alias("_g")), "taken")
    marked = rows.join(chosen, F.struct("group_id").eqNullSafe(F.col("_g")), "left")
    return marked.withColumn(name, F.when(F.col("_g").isNotNull(), "test").otherwise("train")).drop("_g")
