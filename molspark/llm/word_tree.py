"""All words of a class as classes of classes: a tree of small softmaxes whose leaves are the words.

The ``WAYS`` classes of least mass become one class until one is left, so frequent words have short
ways. Each choice on the way to a word is a softmax over the parts of a class given the context: logs
of their masses, and for each feature of the context a row of weights found by a hash of the feature
and the class.

Words that no task holds by name have leaves by their hash: bits of it name a bucket, which is one
leaf of the tree, and as many further bits as tell all of them apart on average name classes below
the bucket, whose parts that have words start out equal.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that a choice tells, and the parts of a class.
BITS = 3
WAYS = 1 << BITS
#: Bits of a hash that name a bucket of words that no task holds by name.
BUCKET_BITS = 16
#: Bits below a bucket, at most, and first bits of a hash by which leaves are gathered. A task holds one
#: bit for each leaf below the buckets.
MOST_DEEPER, GROUP_BITS = 12, 8
#: Bits of the number of rows of weights, which follows the number of learned tokens: at least and at most.
LEAST_BITS, MOST_BITS = 9, 18
#: Words whose ways are walked together.
PIECE = 1 << 14
#: Log of the share of a part that is not there.
NONE = -60.0

_U = np.uint32


class Sent:
    """What tasks get. Arrays come from a pickle with a dtype of their own, equal to numpy's but not the
    same, which ``np.add.at`` takes for another one and works on five times slower."""

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update({k: v.view(v.dtype.type) if isinstance(v, np.ndarray) else v for k, v in state.items()})


@dataclass
class WordTree(Sent):
    """Leaves are the named words, then the buckets that have words; inner nodes come after them."""

    above: np.ndarray  # of each leaf and inner node: the number of the inner node above it times WAYS, plus its part
    bias: np.ndarray  # of each inner node: logs of the masses of its parts
    depth: np.ndarray  # of each leaf
    weights: np.ndarray  # rows x WAYS
    named: int
    leaf_of: np.ndarray  # of each bucket; -1 without words
    held: list[np.ndarray]  # by level below the buckets and class: a bit for each part that has words
    learned: bool = False  # whether there is a weight other than 0

    @staticmethod
    def start(masses: np.ndarray, unnamed: Unnamed, tokens: int) -> WordTree:
        """``masses`` of the named words, and what is known of the others."""
        buckets = unnamed.masses
        held = np.flatnonzero(buckets)
        leaf_of = np.full(len(buckets), -1, np.int32)
        leaf_of[held] = len(masses) + np.arange(len(held))
        above, bias = _merged(np.concatenate([masses, buckets[held]]).astype(np.float64))
        rows = min(max(math.ceil(math.log2(max(tokens, 1))) - BITS, LEAST_BITS), MOST_BITS)
        depth = _depths(above, len(masses) + len(held))
        return WordTree(above, bias, depth, np.zeros((1 << rows, WAYS), np.float32), len(masses), leaf_of, unnamed.levels())

    @property
    def bucket_bits(self) -> int:
        return len(self.leaf_of).bit_length() - 1

    @property
    def leaf_bits(self) -> int:
        """Bits of a hash that name a leaf below the buckets."""
        return self.bucket_bits + BITS * len(self.held)

    def moved(self, step: np.ndarray) -> WordTree:
        return replace(self, weights=self.weights + step, learned=True)

    def leaves(self, named: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Leaves of words by their number among the named ones, or below 0 by their hash."""
        leaf = named.astype(np.int32)
        other = np.flatnonzero(named < 0)
        leaf[other] = self.leaf_of[(hashes[other] >> np.uint64(64 - self.bucket_bits)).astype(np.int64)]
        return leaf

    def choices(self, leaf: np.ndarray, hashes: np.ndarray, contexts: list[np.ndarray]) -> Iterator[tuple]:
        """(words, rows of weights by feature, what the softmax is taken of, own part) of all choices
        on the ways to the words, which come in order of depth, the deepest first; each word is met
        at most once a time. ``contexts`` are hashes of 32 bits, by feature."""
        shift = _U(33 - len(self.weights).bit_length())

        def choice(at, keys, sums, part):
            keys = keys * _U(0x85EBCA6B)
            rows = [(((c[at] ^ keys) * _U(0x9E3779B1)) >> shift).astype(np.int64) for c in contexts]
            for row in rows if self.learned else ():
                sums += np.take(self.weights, row, axis=0)
            return at, rows, sums, part

        at = np.flatnonzero(leaf >= self.named) if self.held else leaf[:0]
        if len(at):
            own = hashes[at]
            for first, held in zip(range(self.bucket_bits, self.leaf_bits, BITS), self.held, strict=True):
                prefix = own >> np.uint64(64 - first)
                part = (own >> np.uint64(64 - first - BITS)).astype(np.int64) & (WAYS - 1)
                keys = ~(prefix + np.uint64(1 << first)).astype(_U)
                yield choice(at, keys, np.take(_EVEN, held[prefix.astype(np.int64)], axis=0), part)
        leaves, node = len(self.depth), leaf
        still = len(leaf) - np.cumsum(np.bincount(np.take(self.depth, leaf), minlength=1))
        for n in still[:-1].tolist():
            step = np.take(self.above, node[:n])
            inner = step >> BITS
            yield choice(slice(0, n), inner.astype(_U), np.take(self.bias, inner, axis=0), step & (WAYS - 1))
            node = inner + leaves

    def _pieces(self, leaf: np.ndarray, hashes: np.ndarray, contexts: np.ndarray) -> Iterator[tuple]:
        """(words, and what ``choices`` takes of them) of all words that have leaves."""
        have = np.flatnonzero(leaf >= 0)
        for start in range(0, len(have), PIECE):
            at = have[start : start + PIECE]
            at = at[np.argsort(~np.take(self.depth, leaf[at]), kind="stable")]
            yield at, leaf[at], hashes[at], [c[at] for c in contexts]

    def logs(self, leaf: np.ndarray, hashes: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Natural logs of the shares of words given their contexts; 0 for leaves below 0."""
        total = np.zeros(len(leaf))
        for at, *words in self._pieces(leaf, hashes, contexts):
            inverse = np.ones(len(at))
            for of, _, sums, part in self.choices(*words):
                np.exp(sums, out=sums)
                inverse[of] *= (sums @ _ONES) / np.take(sums.reshape(-1), _CELLS[: len(part)] + part)
            total[at] = -np.log(inverse)
        return total

    def add(self, leaf: np.ndarray, hashes: np.ndarray, contexts: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> None:
        """Adds how often the parts were met, and how often they were expected, by row of weights."""
        for _, *words in self._pieces(leaf, hashes, contexts):
            for _, rows, sums, part in self.choices(*words):
                np.exp(sums, out=sums)
                sums /= (sums @ _ONES)[:, None]
                for row in rows:
                    cells = row * WAYS
                    np.add.at(observed.reshape(-1), cells + part, np.float32(1))
                    np.add.at(expected.reshape(-1), (cells[:, None] + _PARTS).reshape(-1), sums.reshape(-1))


_ONES, _PARTS, _CELLS = np.ones(WAYS, np.float32), np.arange(WAYS), np.arange(PIECE) * WAYS
_EVEN = np.where(np.arange(1 << WAYS)[:, None] >> _PARTS & 1, 0, NONE).astype(np.float32)


@dataclass
class Unnamed:
    """The masses of words by bucket, and one bit for each leaf below the buckets that has words."""

    masses: np.ndarray
    leaves: np.ndarray | None = None

    @staticmethod
    def none() -> Unnamed:
        return Unnamed(np.zeros(1 << BUCKET_BITS))

    @staticmethod
    def of(words: DataFrame, number: int) -> Unnamed:
        """Of a table (word, n) with ``number`` rows; the mass of a word is its count and one."""
        if not number:
            return Unnamed.none()
        more = min(max(math.ceil(math.log2(number)) - BUCKET_BITS, 0), MOST_DEEPER)
        leaf_bits = BUCKET_BITS + BITS * -(-more // BITS)
        below, within = leaf_bits - GROUP_BITS, BUCKET_BITS - GROUP_BITS

        def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            at = rows["leaf"].to_numpy() & ((1 << below) - 1)
            masses = np.bincount(at >> (below - within), rows["n"].to_numpy() + 1.0, 1 << within)
            leaves = np.zeros(1 << below, bool)
            leaves[at] = True
            return pd.DataFrame({"part": [key[0]], "masses": [masses.tobytes()], "leaves": [np.packbits(leaves, bitorder="little").tobytes()]})

        leaf = hash_prefix(F.col("word"), leaf_bits)
        grouped = words.select(leaf.alias("leaf"), "n").groupBy(F.shiftright("leaf", below).alias("part"))
        found = {r["part"]: r for r in grouped.applyInPandas(gather, "part long, masses binary, leaves binary").collect()}
        parts = [found.get(part) for part in range(1 << GROUP_BITS)]
        masses = np.concatenate([np.frombuffer(r["masses"]) if r else np.zeros(1 << within) for r in parts])
        empty = bytes((1 << below) // 8)
        leaves = np.frombuffer(b"".join(bytes(r["leaves"]) if r else empty for r in parts), np.uint8)
        return Unnamed(masses, leaves if more else None)

    def levels(self) -> list[np.ndarray]:
        """Bits of the parts of all classes, by level from the buckets down."""
        found, bits = [], self.leaves
        while bits is not None and len(bits) >= len(self.masses):
            found.append(bits)
            bits = np.packbits(bits > 0, bitorder="little")
        return found[::-1]


def hash_prefix(word: Column, bits: int) -> Column:
    """The first bits of the hash that names a word's bucket, and the classes below it."""
    return F.shiftrightunsigned(F.xxhash64(word), 64 - bits)


def _merged(masses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``above`` and ``bias`` of the tree that merges the ``WAYS`` least masses until one is left, the
    first time as few as come out even; equal ones in their order, classes after words."""
    n = len(masses)
    inners = -(-(n - 1) // (WAYS - 1)) if n > 1 else 0
    above, bias = np.zeros(n + inners, np.int32), np.full((inners, WAYS), NONE, np.float32)
    order = np.argsort(masses, kind="stable")
    queue = list(zip(masses[order].tolist(), order.tolist(), strict=True))  # sorted, so a heap
    take = (n - 2) % (WAYS - 1) + 2
    for inner in range(inners):
        parts = [heapq.heappop(queue) for _ in range(take)]
        for part, (mass, node) in enumerate(parts):
            above[node], bias[inner, part] = inner * WAYS + part, math.log(mass)
        heapq.heappush(queue, (sum(mass for mass, _ in parts), n + inner))
        take = WAYS
    return above, bias - bias.max(1, keepdims=True) if inners else bias


def _depths(above: np.ndarray, leaves: int) -> np.ndarray:
    depth, at = np.zeros(leaves, np.uint8), np.arange(leaves if leaves > 1 else 0)
    node = at
    while len(at):
        depth[at] += 1
        node = (above[node] >> BITS) + leaves
        on = node != len(above) - 1
        at, node = at[on], node[on]
    return depth
