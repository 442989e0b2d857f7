"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molspark.session import materialize


def _attached(pairs: DataFrame) -> DataFrame:
    """(u, v, low): each directed pair with the least node among u and its neighbours. The least
    is taken per task before the shuffle, so a node of many neighbours is no large group."""
    low = pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("low"))
    return pairs.join(low, "u")


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link, with ``root`` the least node of its component.

    Links may repeat, run either way or join a node to itself; null ends are left out. No links
    give an empty table. Each round writes its pairs to the shared folder, and the number of
    rounds grows with the logarithm of the longest path."""
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    alone = pairs.where("u = v").select(F.col("u").alias("node")).distinct()
    pairs = materialize(pairs.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _attached(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v")
        small = _attached(large)
        small = small.select("u", F.col("low").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("low").alias("v")))
        pairs = materialize(small.where("u != v").distinct(), "links")
        before, state = state, _state(pairs)
        if before == state:
            break
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = found.select(F.col("root").alias("node")).unionByName(alone).distinct().join(found.select("node"), "node", "left_anti")
    return found.unionByName(roots.withColumn("root", F.col("node")))
