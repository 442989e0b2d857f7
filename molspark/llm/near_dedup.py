"""Near-duplicate components by a chosen-path set similarity join.

A document is the set of its five-word shingles. Documents with equal sets form a class. Every
class has a sketch of minwise tokens, and independent trees branch the classes: a node chooses
one token coordinate, sometimes a second one, by a hash of its path, and sends each class to the
child named by its token there. With 1.43 coordinates on average a pair at a threshold of 0.85 meets
in 1.2 children of a node, so its line in a tree dies out with a probability of 0.31 at most,
however deep the tree, while dissimilar classes part after a level or two. At other thresholds
the average is such that a pair meets in as many children.
Nodes of few classes are compared exhaustively on their sketches; larger ones branch on.

Classes of a large node are also linked to its pivot where they resemble it. The pivot is the
member that comes first in one hashed order of all classes, so the nodes of a group of copies share
few pivots in all trees. A node most of whose classes resemble it is dense: it holds near copies that
no token parts. Dense nodes of a bounded size end there, and those of one pivot, which hold about the
same copies in all trees, become one node. Larger dense nodes branch by one coordinate only, which sheds
the others without multiplying the copies. Of the nodes that ended so and of those still large at the
last level only the pairs that all these links leave in different components are compared, so a group
of thousands of copies costs a few pairs for each.

Only links between components matter. Of the candidates of all nodes and trees each class first
confirms the one with the earliest class of the hashed order, which makes a forest; then one
candidate between any two components that are still apart; then all that are left between
components. Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molspark.llm.common import forget, slices
from molspark.llm.components import components
from molspark.llm.fingerprint import shingle_hashes
from molspark.session import materialize, scratch_path, shuffles_dropped

#: A link: 100 * intersection >= percent * union, with this percent unless another is asked for.
PERCENT = 85
#: Minwise tokens of a sketch. Two coordinates are kept for the root of each tree.
TOKENS = 64
#: Children of a node in which a pair at the threshold meets, on average, and the probability with
#: which all trees together may miss it.
MEET, MISSED = 1.2155, 1e-5
#: Classes of a node that is compared exhaustively, at most, and levels of branching.
LEAF, DEPTH = 24, 4
#: Share of a large node's classes that resemble its pivot, from which it is dense.
DENSE = 0.5
#: Standard deviations of the share of equal tokens below the threshold, from which a pair is
#: confirmed.
DEVIATIONS = 5
#: Further rounds of pivots for large nodes, at most, while their open pairs are more than OPEN
#: for each class; what is open then is compared exhaustively. Dense nodes of more classes branch on.
PIVOT_ROUNDS, OPEN = 4, 3000
#: Classes of a block of exhaustive comparison.
BLOCK = 256
#: Rounds in which two components that are apart confirm one candidate, before all others are tried.
FOREST_ROUNDS = 1

_U = np.uint64
_RANDOM = np.random.default_rng(20240515)
_FACTORS = _RANDOM.integers(1, 2**63, TOKENS, dtype=np.uint64) * _U(2) + _U(1)
_TERMS = _RANDOM.integers(0, 2**63, TOKENS, dtype=np.uint64)


@dataclass(frozen=True)
class Search:
    """What the search takes from its threshold: per mille of nodes with a second coordinate, trees,
    and the share of equal tokens from which a pair is confirmed."""

    percent: int
    second: int = field(init=False)
    trees: int = field(init=False)
    candidate: float = field(init=False)

    def __post_init__(self) -> None:
        similar = self.percent / 100
        second = round(1000 * (MEET / similar - 1)) if self.percent > 0 else 1001
        if second > 1000 or self.percent > 100:
            raise ValueError(f"no search is known for a threshold of {self.percent} percent")
        lost = 0.0  # the probability that a pair's line dies out, level by level
        for _ in range(1000):
            one = 1 - similar + similar * lost
            lost = one * (1 - second / 1000) + one * one * second / 1000
        trees = max(1, math.ceil(math.log(MISSED) / math.log(lost))) if lost > 0 else 1
        candidate = math.floor(100 * (similar - DEVIATIONS * math.sqrt(similar * (1 - similar) / TOKENS))) / 100
        for name, value in (("second", second), ("trees", trees), ("candidate", candidate)):
            object.__setattr__(self, name, value)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The top 32 bits of the least value of each hash function, taken in steps of bounded size."""
    best = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 4096):
        part = shingles[start : start + 4096, None] * _FACTORS + _TERMS
        np.minimum(best, part.min(0), out=best)
    return (best >> _U(32)).astype(np.uint32).view(np.int32)


def _key(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, digest of the text, n_shingles, key, sketch) of every row; key and sketch are null
    without shingles."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.md5("text").alias("digest"))
    schema = T.StructType([rows.schema["doc_id"]]).add("digest", "string").add("n_shingles", "long").add("key", "binary").add("sketch", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_key(s) for s in sets], pa.binary()),
                    pa.array([sketch(s) if len(s) else None for s in sets], pa.list_(pa.int32())),
                ],
                ["doc_id", "digest", "n_shingles", "key", "sketch"],
            )
        forget()  # the steps that follow in this worker read no texts

    return rows.mapInArrow(run, schema)


def _child(path: Column, coordinate: Column) -> Column:
    return F.xxhash64(path, coordinate, F.element_at("sketch", coordinate + 1))


def _roots(classes: DataFrame, search: Search) -> DataFrame:
    """(path, node): the children of the roots of all trees."""
    paths = []
    for tree in range(search.trees):
        paths.append(_child(F.lit(-1 - tree), F.lit(2 * tree)))
        if 1000 * tree < search.second * search.trees:
            paths.append(_child(F.lit(-1 - tree), F.lit(2 * tree + 1)))
    return classes.select("node", F.explode(F.array(*paths)).alias("path"))


def _branches(rows: DataFrame, search: Search) -> DataFrame:
    """(path, node, sketch): the children of large nodes (path, node, sketch, dense)."""
    first = F.pmod(F.xxhash64("path", F.lit("first")), F.lit(TOKENS)).cast("int")
    second = F.pmod(F.xxhash64("path", F.lit("second")), F.lit(TOKENS)).cast("int")
    twice = (F.pmod(F.xxhash64("path", F.lit("twice")), F.lit(1000)) < search.second) & ~F.col("dense")
    paths = F.when(twice & (first != second), F.array(_child(F.col("path"), first), _child(F.col("path"), second)))
    paths = paths.otherwise(F.array(_child(F.col("path"), first)))
    return rows.select("node", "sketch", F.explode(paths).alias("path"))


def _early(node: Column) -> Column:
    """The place of a class in the hashed order of all classes."""
    return F.struct(F.xxhash64(node, F.lit("order")).alias("h"), node.alias("node"))


def _sized(rows: DataFrame) -> DataFrame:
    """The rows with size and pivot, for nodes of two classes and more. Sizes and pivots, the earliest
    members, are summed per task and written first, so that a large path can be split in the join."""
    sizes = rows.groupBy("path").agg(F.count("*").alias("size"), F.min(_early(F.col("node"))).alias("first")).where("size > 1")
    sizes = materialize(sizes.select("path", "size", F.col("first.node").alias("pivot")), "near-sizes")
    return rows.join(sizes, "path")


class _Levels:
    """The rows of all levels in one written table, by depth and by whether their node is small. Rows of
    large nodes below the first level carry their sketches, so that only the first is joined to them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.schema = spark, scratch_path(spark, "near-levels"), None

    def add(self, depth: int, rows: DataFrame) -> None:
        small = F.col("size") <= LEAF
        sketch = F.when(~small, F.col("sketch")) if "sketch" in rows.columns else F.lit(None).cast("array<int>")
        rows = rows.select("path", "node", "size", "pivot", sketch.alias("sketch"), F.lit(depth).alias("depth"), small.alias("small"))
        with shuffles_dropped(self.spark):
            rows.write.mode("append").partitionBy("depth", "small").parquet(self.path)
        self.schema = rows.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def large(self, depth: int) -> DataFrame:
        return self.read().where((F.col("depth") == depth) & ~F.col("small")).select("path", "node", "size", "pivot", "sketch")


def _told(above: DataFrame) -> DataFrame:
    """The rows of large nodes with ``share``, that of tokens equal to their pivot's, in place of the sketch.
    The pivot is a row of its node, so its sketch is there."""
    first = above.where("node = pivot").select("path", F.col("sketch").alias("first"))
    return above.join(first, "path").withColumn("share", _agreement(F.col("sketch"), F.col("first"))).drop("first", "sketch")


def _agreement(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x) / TOKENS


def _sketched(pairs: DataFrame, classes: DataFrame, search: Search) -> DataFrame:
    """The pairs (a, b) with ``share``, that of equal tokens, and ``alike``: whether it is enough."""
    left = classes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    right = classes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("share", _agreement(F.col("sketch_a"), F.col("sketch_b")))
    return both.withColumn("alike", F.col("share") >= search.candidate).drop("sketch_a", "sketch_b")


def _ordered(pairs: DataFrame) -> DataFrame:
    rest = [name for name in pairs.columns if name not in ("a", "b")]
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *rest).distinct()


def _alike(pairs: DataFrame, classes: DataFrame, search: Search) -> DataFrame:
    """The distinct pairs (a, b), a < b, whose sketches agree enough."""
    return _sketched(_ordered(pairs), classes, search).where("alike").select("a", "b")


def _compare(leaves: DataFrame, classes: DataFrame, rooted: DataFrame | None, search: Search) -> DataFrame:
    """Similar pairs (a, b, share) within each small node. Without ``rooted`` only a spanning forest, the
    most similar pairs first; otherwise all pairs between different roots."""
    forest = rooted is None
    members = leaves.select("path", "node").join(classes.select("node", "sketch"), "node")
    members = members.withColumn("root", F.col("node")) if forest else members.join(rooted, "node")
    groups = members.groupBy("path").agg(F.collect_list(F.struct("node", "root", "sketch")).alias("members"))
    if not forest:
        groups = groups.where(F.size(F.array_distinct(F.transform("members", lambda m: m["root"]))) > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            members = batch.column(0)
            flat = members.flatten()
            nodes, roots = (flat.field(k).to_numpy() for k in (0, 1))
            tokens = flat.field(2).flatten().to_numpy().reshape(-1, TOKENS)
            ends = np.cumsum(np.array([len(m) for m in members]))
            a, b, shares = [], [], []
            for start, end in zip(ends - [len(m) for m in members], ends, strict=True):
                own = tokens[start:end]
                share = (own[:, None, :] == own[None, :, :]).mean(2)
                x, y = np.nonzero(np.triu(share >= search.candidate, 1))
                if not len(x):
                    continue
                if forest:
                    x, y = _forest(x, y, share[x, y], end - start)
                else:
                    apart = roots[start + x] != roots[start + y]
                    x, y = x[apart], y[apart]
                a.append(nodes[start + x])
                b.append(nodes[start + y])
                shares.append(share[x, y])
            a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
            shares = np.concatenate(shares) if shares else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(shares)], ["a", "b", "share"])

    return groups.select("members").mapInArrow(run, "a long, b long, share double").distinct()


def _forest(x: np.ndarray, y: np.ndarray, share: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    above = list(range(n))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    taken = []
    for k in np.argsort(-share, kind="stable"):
        i, j = top(x[k]), top(y[k])
        if i != j:
            above[i] = j
            taken.append(k)
    return x[taken], y[taken]


def _full_sets(docs: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, shingles): the whole set of each node as sorted 64-bit hashes, from the text of the
    document that stands for its class."""
    wanted = nodes.distinct().join(classes.select("node", "key", "doc_id"), "node")
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    rows = wanted.join(texts, F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for node, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shingles = shingle_set(text or b"")
                if _key(shingles) == key:  # an id that repeats with other texts
                    out.append((node, shingles.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], ["node", "shingles"]
            )
        forget()

    return rows.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _confirm(pairs: DataFrame, sets: DataFrame, search: Search) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= search.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _descended(classes: DataFrame, forest: DataFrame) -> DataFrame:
    """(node, root): the classes with the root of their tree, themselves without a link. Of a link of
    ``forest`` the later class is the child, and no class is the child of two; each pass halves every way
    up. Roots are written again after every round of links, so sketches stay with the classes."""
    a, b = _early(F.col("a")), _early(F.col("b"))
    ups = materialize(forest.select(F.greatest(a, b)["node"].alias("node"), F.least(a, b)["node"].alias("root")), "near-ups")
    moved = not ups.isEmpty()
    while moved:
        above = ups.select(F.col("node").alias("root"), F.col("root").alias("above"))
        ups = materialize(ups.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "near-ups")
        moved, ups = not ups.where("moved").isEmpty(), ups.drop("moved")
    return materialize(classes.select("node").join(ups, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-rooted")


def _joined(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """``rooted`` with the roots that links connect made one: components of what is still apart."""
    ends = rooted.select("node", "root")
    met = links.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").where("x != y")
    met = materialize(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-met")
    if met.isEmpty():
        return rooted
    found = components(met).select(F.col("node").alias("root"), F.col("root").alias("one"))
    return rooted.join(found, "root", "left").withColumn("root", F.coalesce("one", "root")).drop("one")


def _open_pairs(large: DataFrame, rooted: DataFrame) -> DataFrame:
    """(path, node, root, main) of the rows of large nodes that hold several components; ``main``
    is the component with most of them."""
    rows = large.select("path", "node").join(rooted, "node")
    counts = rows.groupBy("path", "root").count()
    main = counts.groupBy("path").agg(F.max(F.struct("count", "root")).alias("m"), F.count("*").alias("n")).where("n > 1")
    return rows.join(materialize(main.select("path", F.col("m.root").alias("main")), "near-main"), "path")


def _dealt(open_rows: DataFrame) -> DataFrame:
    """(path, i, j, node, root, asks): the blocks in which the rows outside the main component of a large
    node meet each other and the rows of that component, any two in one block. Rows are dealt to parts of
    about ``BLOCK`` classes, those outside first. Block (i, j), i <= j, holds the asking rows of part i and
    those of part j; a block of one part holds it once."""
    outside = F.sum((F.col("root") != F.col("main")).cast("int"))
    parts = open_rows.groupBy("path").agg(F.ceil(outside / BLOCK).cast("int").alias("asking"), F.ceil((F.count("*") - outside) / BLOCK).cast("int").alias("rest"))

    def within(side: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(side)).cast("int")

    part = F.when(F.col("root") != F.col("main"), within("asking")).otherwise(F.col("asking") + within("rest"))
    rows = open_rows.join(parts, "path").withColumn("part", part)
    asking = rows.where("part < asking").withColumn("j", F.explode(F.sequence("part", F.col("asking") + F.col("rest") - 1)))
    asked = rows.where("part > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.least("part", "asking") - 1)))
    asking = asking.select("path", F.col("part").alias("i"), "j", "node", "root", F.lit(True).alias("asks"))
    return asking.unionByName(asked.select("path", "i", F.col("part").alias("j"), "node", "root", F.lit(False).alias("asks")))


def _link_blocks(open_rows: DataFrame, classes: DataFrame, sets: DataFrame, search: Search) -> DataFrame:
    """Links (a, b) of different roots between the rows outside the main component of a large node
    and all its rows, in blocks of about ``BLOCK`` by ``BLOCK`` classes. Pairs whose sketches agree
    are confirmed on the full sets in the block, and of the links of a block a spanning forest
    leaves it, so no group's pairs are written out."""
    rows = _dealt(open_rows).join(classes.select("node", "sketch"), "node").join(sets, "node")
    member = F.struct("node", "root", "sketch", "shingles")
    blocks = rows.groupBy("path", "i", "j").agg(F.collect_list(F.when(F.col("asks"), member)).alias("x"), F.collect_list(F.when(~F.col("asks"), member)).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, alone in enumerate(batch.column(2).to_pylist()):
                sides = [batch.column(0 if alone else k).slice(row, 1).flatten() for k in (0, 1)]
                nodes, roots = ([side.field(k).to_numpy() for side in sides] for k in (0, 1))
                tokens = [side.field(2).flatten().to_numpy().reshape(-1, TOKENS) for side in sides]
                full = [[np.frombuffer(s, np.uint64) for s in side.field(3).to_pylist()] for side in sides]
                agree = np.zeros((len(nodes[0]), len(nodes[1])), np.int16)
                for k in range(TOKENS):
                    agree += tokens[0][:, k, None] == tokens[1][None, :, k]
                close = (agree >= search.candidate * TOKENS) & (roots[0][:, None] != roots[1][None, :])
                close = np.triu(close, 1) if alone else close
                found = [(i, j) for i in range(len(nodes[0])) for j in _linked(full[0][i], full[1], np.flatnonzero(close[i]), search.percent)]
                if found:
                    x, y = np.array(found).T
                    names, ends = np.unique(np.concatenate([nodes[0][x], nodes[1][y]]), return_inverse=True)
                    x, y = _forest(ends[: len(x)], ends[len(x) :], np.ones(len(x)), len(names))
                    a, b = names[x], names[y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    met = blocks.where((F.size("x") > 0) & ((F.col("i") == F.col("j")) | (F.size("y") > 0)))
    return met.select("x", "y", (F.col("i") == F.col("j")).alias("alone")).mapInArrow(run, "a long, b long").distinct()


def _linked(one: np.ndarray, others: list[np.ndarray], asked: np.ndarray, percent: int) -> list[int]:
    """Which of the asked sets are linked with the one."""
    if not len(asked):
        return []
    sizes = np.array([len(others[j]) for j in asked])
    flat = np.concatenate([others[j] for j in asked])
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    both = np.add.reduceat((one[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return asked[100 * both >= percent * (len(one) + sizes - both)].tolist()


def _merged(rooted: DataFrame, new: DataFrame) -> DataFrame:
    """``rooted`` after the links ``new``. A component takes the least root that it is linked to; that
    joins connected nodes only, and the components proper come from all links in the end."""
    if new.isEmpty():
        return rooted
    ends = rooted.select("node", "root")
    met = new.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").where("x != y")
    taken = met.groupBy(F.greatest("x", "y").alias("root")).agg(F.min(F.least("x", "y")).alias("taken"))
    rooted = rooted.join(taken, "root", "left").withColumn("root", F.coalesce("taken", "root")).drop("taken")
    return materialize(rooted, "near-rooted")


def _apart(pairs: DataFrame, rooted: DataFrame) -> DataFrame:
    """(a, b, x, y) of the pairs whose ends have different roots x < y."""
    ends = rooted.select("node", "root")
    met = pairs.join(ends.toDF("a", "_x"), "a").join(ends.toDF("b", "_y"), "b").where("_x != _y")
    return met.select("a", "b", "share", F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y"))


class _Links:
    """Links that were confirmed and pairs that were tried, each in one written table."""

    def __init__(self, spark: SparkSession, sets: DataFrame, search: Search):
        self.spark, self.sets, self.search = spark, sets, search
        self.links, self.tried = scratch_path(spark, "near-links"), scratch_path(spark, "near-tried")

    def read(self, path: str) -> DataFrame:
        return self.spark.read.schema("a long, b long, turn string").parquet(path).select("a", "b")

    def confirm(self, pairs: DataFrame, turn: str) -> DataFrame:
        """The links among the pairs (a, b), each confirmed at most once."""
        return self.add(_confirm(self._append(self.tried, pairs, turn), self.sets, self.search), turn)

    def add(self, links: DataFrame, turn: str) -> DataFrame:
        return self._append(self.links, links, turn)

    def _append(self, path: str, pairs: DataFrame, turn: str) -> DataFrame:
        with shuffles_dropped(self.spark):
            pairs.select("a", "b", F.lit(turn).alias("turn")).write.mode("append").partitionBy("turn").parquet(path)
        return self.spark.read.schema("a long, b long, turn string").parquet(path).where(F.col("turn") == turn).select("a", "b")

    def untried(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.read(self.tried), ["a", "b"], "left_anti")


def _resolved(links: _Links, pairs: DataFrame, rooted: DataFrame, turn: str) -> DataFrame:
    """``rooted`` after all of the pairs (a, b, share) that lie between components were tried, the most
    alike of any two components first."""
    for k in range(FOREST_ROUNDS):
        pairs = materialize(_apart(links.untried(pairs), rooted), "near-apart")  # what is together stays so
        best = pairs.groupBy("x", "y").agg(F.max(F.struct("share", "a", "b")).alias("p"))
        rooted = _merged(rooted, links.confirm(best.select("p.a", "p.b"), f"{turn}-{k}"))
    return _merged(rooted, links.confirm(_apart(links.untried(pairs), rooted), f"{turn}-rest"))


def rooted_classes(docs: DataFrame, classes: DataFrame, search: Search) -> DataFrame:
    """(key, doc_id, root) of the classes, with a root that is equal for classes that confirmed links connect."""
    spark = docs.sparkSession
    levels, large, star = _Levels(spark), [], []
    rows = _sized(_roots(classes, search))
    for depth in range(DEPTH + 1):
        levels.add(depth, rows)
        above = levels.large(depth)
        if above.isEmpty():
            break
        if depth == 0:
            above = materialize(above.drop("sketch").join(classes.select("node", "sketch"), "node"), "near-above")
        told = materialize(_told(above), "near-told")
        alike = F.col("share") >= search.candidate
        star.append(told.where(alike).select(F.col("pivot").alias("a"), F.col("node").alias("b"), "share"))
        dense = told.groupBy("path").agg((F.avg(alike.cast("int")) >= DENSE).alias("dense"), F.first("size").alias("n"))
        dense = materialize(dense.select("path", "dense", (F.col("dense") & (F.col("n") <= OPEN)).alias("ended")), "near-dense")
        # nodes of one pivot hold about the same copies
        ended = told.join(dense.where("ended"), "path")
        large.append(ended.select(F.xxhash64("pivot", F.lit("ended")).alias("path"), "node"))
        left = above.join(dense.where("not ended"), "path")
        if depth == DEPTH:
            large.append(left.select("path", "node"))
            break
        # written, so that sizes and rows come from one branching
        rows = _sized(materialize(_branches(left, search), "near-branches"))
    small = levels.read().where("small").select("path", "node")
    large = materialize(functools.reduce(DataFrame.unionByName, large, small.limit(0)).distinct(), "near-large")
    star = functools.reduce(DataFrame.unionByName, star, classes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("share")).limit(0))

    pairs = materialize(_compare(small, classes, None, search).unionByName(_ordered(star)).distinct(), "near-pairs")
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(large.select("node"))
    sets = materialize(_full_sets(docs, needed, classes), "near-sets")
    links = _Links(spark, sets, search)
    a, b = _early(F.col("a")), _early(F.col("b"))
    turned = pairs.select(F.greatest(a, b).alias("late"), F.struct(-F.col("share"), F.least(a, b).alias("early")).alias("best"))
    forest = turned.groupBy("late").agg(F.min("best").alias("best")).select(F.col("late.node").alias("a"), F.col("best.early.node").alias("b"))
    new = links.confirm(_ordered(forest), "forest")
    rooted = _descended(classes, new)
    rooted = _resolved(links, pairs, rooted, "pairs")

    for turn in range(PIVOT_ROUNDS + 1):
        open_rows = materialize(_open_pairs(large, rooted), "near-open")
        if turn == PIVOT_ROUNDS:
            break
        outside = open_rows.where("root != main")
        # what exhaustive comparison would cost: rows outside the main component times all rows
        cost = open_rows.groupBy("path").agg((F.sum(F.when(F.col("root") != F.col("main"), 1).otherwise(0)) * F.count("*")).alias("cost"))
        total = cost.agg(F.sum("cost")).first()[0] or 0
        if total <= OPEN * open_rows.count():
            break
        chosen = F.min(F.struct(F.xxhash64("path", "node", F.lit(turn)).alias("h"), F.col("node").alias("b")))
        pivots = materialize(open_rows.where("root = main").groupBy("path").agg(chosen.alias("c")).select("path", F.col("c.b").alias("b")), "near-pivots")
        asked = _alike(outside.select("path", F.col("node").alias("a")).join(pivots, "path").select("a", "b"), classes, search)
        new = links.confirm(links.untried(asked), f"pivots-{turn}")
        if new.isEmpty():
            break
        rooted = _merged(rooted, new)
    rooted = _merged(rooted, links.add(_link_blocks(open_rows, classes, sets, search), "blocks"))
    rooted = _resolved(links, materialize(_compare(small, classes, rooted, search), "near-pairs"), rooted, "small")
    return classes.select("node", "key", "doc_id").join(_joined(rooted, links.read(links.links)), "node").drop("node")


def _judged(docs: DataFrame, percent: int) -> DataFrame:
    search = Search(percent)
    rows = materialize(sketches(docs), "near-sketches")
    grouped = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    rooted = materialize(rooted_classes(docs, classes, search), "near-rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_key = rooted.select("key", "root").join(least, "root").select("key", "component_id")
    joined = rows.drop("sketch").join(by_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(False))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "digest")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Links join sets of Jaccard similarity ``percent`` / 100 and more; ``component_id`` is the least doc_id
    reachable, and the row of that id is kept. Null texts count as empty; a row without words is
    linked with nothing and is its own component. Null ids sort after all others: a component of
    null ids alone has no id and keeps none of them by id. Rows that repeat an id and its text
    share its fate. An empty table gives an empty one; other columns are ignored. All rows and
    whole texts take part; no group, node or bucket is cut short.
    """
    return _judged(docs, percent).drop("digest")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the row of the
    least id, and all rows without an id or without words. Rows that repeat an id are told apart by
    their texts."""
    dropped = _judged(docs, percent).where("not kept and doc_id is not null and component_id is not null")
    dropped = dropped.select(F.col("doc_id").alias("__near_id"), F.col("digest").alias("__near_digest")).distinct()
    same = (F.col("doc_id") == F.col("__near_id")) & (F.md5("text") == F.col("__near_digest"))
    return docs.join(dropped, same, "left_anti").select(docs.columns)
