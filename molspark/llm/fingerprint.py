"""Document fingerprints by one-permutation MinHash.

Every five-word shingle is hashed once; the top bits of the hash choose a bin and each bin keeps
its smallest hash. Empty bins copy the bin that a hash sequence of their own number reaches first
among the filled ones (optimal densification), so that equal bins agree with the probability of
the sets' similarity. Of every bin only the low bits are stored; that unequal bins agree in them
by chance is taken off again when two fingerprints are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molspark.llm.common import words_of, worker_memory

WORDS = 5
#: Bins, a power of two, and bits that are stored of each: one hexadecimal digit.
BINS = 512
BITS = 4
REMEMBERED_WORDS = 500_000
#: Texts that one range of neighbours holds, on average.
ROWS_PER_RANGE = 1_000
MAX_RANGES = 20_000

_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """64-bit hashes of words, remembered by a worker; a full memory loses its newer half."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            for old in list(self)[len(self) // 2 :]:
                del self[old]
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def shingle_hashes(text: bytes) -> np.ndarray:
    """Hashes of all runs of five words, repeats included; fewer words make one shingle, and none
    no shingle."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    known = worker_memory("word hashes", WordHashes)
    return runs_of(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))


def runs_of(hashes: np.ndarray) -> np.ndarray:
    """Hash of each run of five word hashes: a sum with odd factors by place, mixed once."""
    if not len(hashes):
        return hashes
    size = min(WORDS, len(hashes))
    n = len(hashes) - size + 1
    total = hashes[:n] * _PLACES[0]
    for j in range(1, size):
        total += hashes[j : j + n] * _PLACES[j]
    return mixed(total + _U(size))


def bins_of(hashes: np.ndarray) -> np.ndarray:
    """Smallest remaining hash of each bin, empty ones densified; all bins empty without hashes."""
    out = np.full(BINS, _EMPTY, np.uint64)
    np.minimum.at(out, (hashes >> _SHIFT).astype(np.int64), hashes & _REST)
    filled = out != _EMPTY
    if filled.all() or not len(hashes):
        return out
    source, todo = np.arange(BINS), np.flatnonzero(~filled)
    for attempt in range(6):
        reach = _ORDER[todo, attempt]
        hit = filled[reach]
        source[todo[hit]] = reach[hit]
        todo = todo[~hit]
    if len(todo):
        full = np.flatnonzero(filled)
        source[todo] = full[_RANK[np.ix_(todo, full)].argmin(1)]
    return out[source]


def _orders() -> tuple[np.ndarray, np.ndarray]:
    """For each bin the order in which it looks at all bins when it is empty, and its inverse."""
    order = mixed(np.arange(BINS * BINS, dtype=np.uint64) * _U(_PRIME) + _U(1)).reshape(BINS, BINS).argsort(1)
    rank = np.empty((BINS, BINS), np.int16)
    np.put_along_axis(rank, order, np.arange(BINS, dtype=np.int16)[None, :], 1)
    return order, rank


_PLACES = [_U(pow(_PRIME, j + 1, 1 << 64)) for j in range(WORDS)]
_EMPTY = np.iinfo(np.uint64).max
_SHIFT = _U(64 - (BINS.bit_length() - 1))
_REST = (_U(1) << _SHIFT) - _U(1)
_SALTS = np.arange(BINS, dtype=np.uint64)
_ORDER, _RANK = _orders()


def low_bits(hashes: np.ndarray) -> np.ndarray | None:
    """The low bits of all bins, None for a text without words. The bin's number goes in, so that
    copies of one hash do not agree by chance all at once."""
    if not len(hashes):
        return None
    return (mixed(bins_of(hashes) * _U(_PRIME) + _SALTS) & _U((1 << BITS) - 1)).astype(np.uint8)


def pack(low: np.ndarray | None) -> str:
    """Hex digits of the bins' bits; empty for a text without words."""
    return "" if low is None else ((low[::2] << BITS) | low[1::2]).tobytes().hex()


def fingerprint(text: bytes) -> str:
    return pack(low_bits(shingle_hashes(text)))


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity, 0 to 1: 1 for two empty fingerprints, 0 for one."""
    return _likeness(*(np.frombuffer(bytes.fromhex("0".join(["", *f])), np.uint8) if f else None for f in (a, b)))


def _likeness(x: np.ndarray | None, y: np.ndarray | None) -> float:
    if x is None or y is None:
        return float(x is y)
    agree, chance = np.count_nonzero(x == y) / BINS, 0.5**BITS
    return min(1.0, max(0.0, (agree - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Append the fingerprint of each whole text; null counts as empty. All rows and columns stay."""
    rows = docs.drop(out)
    schema = T.StructType(list(rows.schema.fields)).add(out, "string")
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


_LAST = -(1 << 63)


def _in_ranges(docs: DataFrame, rows_per_range: int) -> tuple[DataFrame, int]:
    """(doc_id, text, key, part, ghost): rows cut into ranges of descending id, each range with a
    ghost of the row that follows its last one (the first of the next range, and after the last
    range the first of all). Only range borders come to the driver, at most ``MAX_RANGES``."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("key"))
    n = rows.select("key").count()
    wanted = max(1, min(MAX_RANGES, -(-n // rows_per_range)))
    shares = [i / wanted for i in range(1, wanted)] + [1.0]
    cuts = rows.agg(F.percentile_approx("key", shares, max(10_000, 10 * wanted)).alias("cuts")).first()["cuts"]
    ascending = np.array(sorted(set(cuts or [0])), np.int64)
    last = len(ascending) - 1

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series(last - np.searchsorted(ascending, key.to_numpy()).clip(0, last))

    # range k holds the ids above the next smaller border up to its own, its largest
    ghosts = rows.where(F.col("key").isin(ascending.tolist()))
    ghosts = ghosts.withColumn("part", F.pmod(part("key") - 1, F.lit(last + 1)))
    every = rows.withColumns({"part": part("key"), "ghost": F.lit(0)}).unionByName(ghosts.withColumn("ghost", F.lit(1)))
    return every, last + 1


def neighbour_fingerprints(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text ends in the first half as many characters of the next document by descending
    doc_id; the last document's next is the first. Null texts count as empty, null ids come
    last, rows of equal id follow each other by text, and a lone row is its own next. Texts
    without words have the empty fingerprint. An empty table gives an empty one; other columns
    are ignored.

    Texts are shuffled once, to their range of ids; a task streams through its sorted ranges and
    holds two texts at a time.
    """
    rows, n_ranges = _in_ranges(docs, rows_per_range)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out, id_type = None, [], None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "ghost"))
            for doc_id, text, ghost in zip(*columns, strict=True):
                if ghost and before is None:
                    continue
                print_ = low_bits(shingle_hashes(text.encode("utf-8", "surrogatepass")))
                if before is not None:
                    out.append(_edited(*before, text, print_))
                before = None if ghost else (doc_id, text, print_)
                if len(out) >= 1000:
                    yield _batch(out, names, [id_type, *types[1:]])
                    out = []
        if out:
            yield _batch(out, names, [id_type, *types[1:]])

    dealt = rows.repartition(n_ranges, "part").sortWithinPartitions("part", "ghost", F.desc("key"), "text")
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("doc_id", "text", "ghost").mapInArrow(run, schema)


def _edited(doc_id: int | None, text: str, own: np.ndarray | None, following: str, following_bits: np.ndarray | None) -> tuple:
    half = len(text) // 2
    data = (text[: len(text) - half] + following[:half]).encode("utf-8", "surrogatepass")
    bits = low_bits(shingle_hashes(data))
    return doc_id, len(text), hashlib.sha256(data).hexdigest(), pack(own), pack(bits), _likeness(own, bits), _likeness(own, following_bits)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
