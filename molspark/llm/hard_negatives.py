"""Exact hard negatives from blocks of vectors in Hilbert order, chosen by interval bounds.

Rows are sorted by label, then along a Hilbert curve, and cut into blocks: one Parquet row each, with
the block's rows packed and, in columns of their own, its zone map, the least and greatest of every
component and of the labels. The inner product of an anchor and any row of a block lies between two
sums that interval arithmetic gives from the zone map. An anchor reads a block only if these bounds
meet what it looks for: first the best rows of its label, which must reach the score it already has
from its own block, then the score windows below its positives, in rows of other labels.

Anchors travel, packed, to the blocks that they must read; a block is sent once. Zone maps are read in
pages. Every table of blocks, pages, anchors or requests is spread by its key, none is broadcast or
collected. What is found is exact: bounds only leave out blocks that cannot hold a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molspark.session import materialize

#: Rows of a block, zone maps of a page (about), anchors of a pack.
BLOCK_ROWS = 512
PAGE_BLOCKS = 1024
PACK_ANCHORS = 1024
#: The curve runs through this many leading components, each cut in 2 ** CURVE_BITS cells.
CURVE_DIMS = 64
CURVE_BITS = 2
#: Score of an anchor without enough rows of its label in its own block.
NONE_YET = -(1 << 62)

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null if the vector or a component is null or not finite."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of cells (n x d, values below 2 ** bits) on the Hilbert curve, as n rows of bytes that
    sort like the places. Bits are exchanged and inverted from the highest on, then Gray coded."""
    n, dims = cells.shape
    if dims == 0:
        return np.zeros((n, 0), np.uint8)
    x = cells.T.astype(np.uint32).copy()
    for level in range(bits - 1, 0, -1):
        below = np.uint32((1 << level) - 1)
        for i in range(dims):
            high = (x[i] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & below).astype(np.uint32)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flips = np.zeros(n, np.uint32)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> level) & 1 == 1, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= flips
    planes = [(x >> level) & 1 for level in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).astype(np.uint8).T, axis=1)


@dataclass(frozen=True)
class Shape:
    """What all vectors of a table share: number of components, range of their values."""

    dims: int
    least: int
    most: int

    @property
    def stored(self) -> str:
        """Narrowest type that holds every component."""
        bound = max(abs(self.least), abs(self.most))
        return "<i2" if bound < 1 << 15 else "<i4" if bound < 1 << 31 else "<i8"

    @property
    def summed(self):
        """Doubles where all products and sums are exact, else 64-bit integers."""
        return np.float64 if max(abs(self.least), abs(self.most)) ** 2 * max(self.dims, 1) < 1 << 52 else np.int64

    def unpack(self, packed: bytes) -> np.ndarray:
        size = np.dtype(self.stored).itemsize * self.dims
        rows = len(packed) // size if size else 0
        return np.frombuffer(packed, self.stored).reshape(rows, self.dims).astype(self.summed)


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """A column of vectors as rows of equal length; short vectors end in zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def _curve(shape: Shape) -> Callable:
    dims = min(shape.dims, CURVE_DIMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("vector"), shape.dims)
            share = (rows[:, :dims].astype(np.float64) - shape.least) / (float(shape.most) - shape.least + 1)
            cells = np.clip(share * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1).astype(np.uint32)
            keys = [key.tobytes() for key in hilbert_keys(cells, CURVE_BITS)]
            packed = [row.tobytes() for row in rows.astype(shape.stored)]
            kept = [batch.column(name) for name in ("id", "label", "anchor")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["id", "label", "anchor", "key", "vector"])

    return run


def _first(mask: np.ndarray, scores: np.ndarray, ids: np.ndarray, ats: np.ndarray, most: int):
    """(row, column) of the ``most`` best columns of every row under the mask: highest score, then least
    id, then least place."""
    rows, cols = np.nonzero(mask)
    order = np.lexsort((ats[cols], ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < most], cols[rank < most]


_BLOCK = "block long, first long, n int, label_least long, label_most long, least array<long>, most array<long>, ids array<long>, labels array<long>, vectors binary, places array<int>, floors array<long>"


def _cut(shape: Shape, positives: int) -> Callable:
    """Sorted rows into blocks, each with its anchors' places and the scores that they have there."""

    def block(part: int, seq: int, first: int, ids, labels, anchors, packed) -> pa.RecordBatch:
        vectors = shape.unpack(packed) if shape.dims else np.zeros((len(ids), 0), shape.summed)
        places = np.flatnonzero(anchors)
        scores = vectors[places] @ vectors.T
        scores = np.where(labels[places][:, None] == labels[None, :], scores, NONE_YET)
        scores[np.arange(len(places)), places] = NONE_YET
        enough = len(ids) >= positives
        floors = -np.partition(-scores, positives - 1, axis=1)[:, positives - 1] if enough and len(places) else np.full(len(places), NONE_YET)
        row = {
            "block": part << 33 | seq, "first": (part << 40) + first, "n": len(ids), "label_least": labels.min(), "label_most": labels.max(),
            "least": vectors.min(axis=0).astype(np.int64), "most": vectors.max(axis=0).astype(np.int64), "ids": ids, "labels": labels, "vectors": packed,
            "places": places.astype(np.int32), "floors": floors.astype(np.int64),
        }
        kinds = {"block": pa.int64(), "first": pa.int64(), "n": pa.int32(), "label_least": pa.int64(), "label_most": pa.int64(), "vectors": pa.binary(), "places": pa.list_(pa.int32())}
        return pa.RecordBatch.from_arrays([pa.array([value], kinds.get(name, pa.list_(pa.int64()))) for name, value in row.items()], list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first, kept = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kept = table if kept is None else pa.concat_tables([kept, table])
            while kept.num_rows >= BLOCK_ROWS:
                yield block(part, seq, first, *_columns(kept.slice(0, BLOCK_ROWS)))
                kept, seq, first = kept.slice(BLOCK_ROWS), seq + 1, first + BLOCK_ROWS
        if kept is not None and kept.num_rows:
            yield block(part, seq, first, *_columns(kept))

    return run


def _columns(table: pa.Table):
    ids, labels, anchors = (table.column(name).to_numpy() for name in ("id", "label", "anchor"))
    return ids, labels, anchors, b"".join(table.column("vector").to_pylist())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors (at, label, vector, highs) as packs: their numbers and vectors as bytes."""
    names = ("ats", "labels", "highs", "vectors")
    for batch in batches:
        for start in range(0, batch.num_rows, PACK_ANCHORS):
            rows = batch.slice(start, PACK_ANCHORS)
            ats, labels = (rows.column(name).to_numpy().astype("<i8").tobytes() for name in ("at", "label"))
            highs = rows.column("highs").flatten().to_numpy().astype("<i8").tobytes()
            packed = [ats, labels, highs, b"".join(rows.column("vector").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], list(names))


_PACK = "ats binary, labels binary, highs binary, vectors binary"


def _unpack(row: dict, shape: Shape):
    ats, labels = (np.frombuffer(row[name], "<i8") for name in ("ats", "labels"))
    highs = np.frombuffer(row["highs"], "<i8").reshape(len(ats), -1)
    return ats, labels, highs, shape.unpack(row["vectors"]) if shape.dims else np.zeros((len(ats), 0), shape.summed)


def _bounds(vectors: np.ndarray, least: np.ndarray, most: np.ndarray):
    """Least and greatest inner product of every vector with any point of every box."""
    up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
    return up @ least.T + down @ most.T, up @ most.T + down @ least.T


def _lows(highs: np.ndarray, percent: int) -> np.ndarray:
    """Least scores of the windows: percent * high <= 100 * score."""
    return -((-percent * highs) // 100)


def _rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i] for name in batch.schema.names}


def _binary(row: dict, names=("ats", "labels", "highs", "vectors")) -> dict:
    return {name: row[name].as_py() for name in names}


def _choose(shape: Shape, percent: int | None) -> Callable:
    """Packs next to pages of zone maps into requests: a block and the anchors that must read it.
    With ``percent``, anchors look for other labels in their windows; without, for their own label
    from a score on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows_of(batch):
                pack = _binary(row)
                ats, labels, highs, vectors = _unpack(pack, shape)
                zones = row["zones"].values
                blocks, label_least, label_most = (zones.field(name).to_numpy() for name in ("block", "label_least", "label_most"))
                least, most = (_matrix(zones.field(name), shape.dims).astype(shape.summed) for name in ("least", "most"))
                under, over = _bounds(vectors, least, most)
                if percent is None:
                    needed = (labels[:, None] >= label_least) & (labels[:, None] <= label_most) & (over >= highs[:, :1])
                else:
                    needed = np.zeros(over.shape, bool)
                    for high in highs.T:
                        needed |= (high >= 0)[:, None] & (over >= _lows(high, percent)[:, None]) & (under <= high[:, None])
                    needed &= (labels[:, None] != label_least) | (labels[:, None] != label_most)
                out = []
                raw = np.frombuffer(pack["vectors"], shape.stored).reshape(len(ats), shape.dims)
                for j in np.flatnonzero(needed.any(axis=0)):
                    some = needed[:, j]
                    out.append((int(blocks[j]), ats[some].tobytes(), labels[some].tobytes(), highs[some].tobytes(), raw[some].tobytes()))
                for start in range(0, len(out), 64):
                    columns = list(zip(*out[start : start + 64], strict=True))
                    arrays = [pa.array(columns[0], pa.int64()), *(pa.array(column, pa.binary()) for column in columns[1:])]
                    yield pa.RecordBatch.from_arrays(arrays, ["block", "ats", "labels", "highs", "vectors"])

    return run


_FOUND = "at long, place int, score long, id long, candidate long"


def _read(shape: Shape, percent: int | None, most: int) -> Callable:
    """Requests next to their blocks into the best candidates of every anchor (and window) there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows_of(batch):
                ats, labels, highs, vectors = _unpack(_binary(row), shape)
                ids, theirs = (row[name].values.to_numpy() for name in ("ids", "block_labels"))
                places = row["first"].as_py() + np.arange(len(ids))
                rows = shape.unpack(row["block_vectors"].as_py()) if shape.dims else np.zeros((len(ids), 0), shape.summed)
                scores = (vectors @ rows.T).astype(np.int64)
                same = labels[:, None] == theirs
                if percent is None:
                    masks = [same & (scores >= highs[:, :1]) & (ats[:, None] != places)]
                else:
                    masks = [~same & (high >= 0)[:, None] & (scores >= _lows(high, percent)[:, None]) & (scores <= high[:, None]) for high in highs.T]
                for place, mask in enumerate(masks):
                    r, c = _first(mask, scores, ids, places, most)
                    arrays = [ats[r], np.full(len(r), place, np.int32), scores[r, c], ids[c], places[c]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["at", "place", "score", "id", "candidate"])

    return run


def _best(found: DataFrame, most: int) -> DataFrame:
    """The first of every anchor and window, cut per task before the shuffle, with their ranks."""
    order = Window.partitionBy("at", "place").orderBy(F.desc("score"), "id", "candidate")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


class Blocks:
    """A written table of blocks in curve order, with the searches that run on it."""

    def __init__(self, rows: DataFrame, shape: Shape, positives: int):
        """``rows``: id, label, vector (array of long), anchor (boolean), all without nulls."""
        self.shape = shape
        keyed = rows.mapInArrow(_curve(shape), "id long, label long, anchor boolean, key binary, vector binary")
        ordered = keyed.repartitionByRange("label", "key", "id").sortWithinPartitions("label", "key", "id")
        self.table = materialize(ordered.mapInArrow(_cut(shape, positives), _BLOCK), "vector-blocks")
        count, anchors = self.table.agg(F.count("*"), F.sum(F.size("places"))).first()
        self.pages, self.packs = -(-count // PAGE_BLOCKS), -(-(anchors or 0) // PACK_ANCHORS)

    def anchors(self) -> DataFrame:
        """at, id, label, vector (packed) and floor of every anchor."""
        size = np.dtype(self.shape.stored).itemsize * self.shape.dims
        told = self.table.where(F.size("places") > 0).withColumn("found", F.explode(F.arrays_zip("places", "floors")))
        place = F.col("found.places")
        return told.select(
            (F.col("first") + place).alias("at"), F.element_at("ids", place + 1).alias("id"), F.element_at("labels", place + 1).alias("label"),
            F.substring("vectors", place * size + 1, F.lit(size)).alias("vector"), F.col("found.floors").alias("floor"),
        )

    def search(self, anchors: DataFrame, percent: int | None, most: int) -> DataFrame:
        """(at, place, score, id, candidate, rank) from anchors (at, label, vector, highs)."""
        packs = anchors.select("at", "label", "vector", "highs").repartitionByRange(max(self.packs, 1), "at").mapInArrow(_pack, _PACK)
        zone = F.struct("block", "label_least", "label_most", "least", "most")
        pages = self.table.withColumn("page", F.pmod(F.xxhash64("block"), F.lit(self.pages))).groupBy("page").agg(F.collect_list(zone).alias("zones"))
        asked = packs.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.pages - 1).cast("long"))))
        requests = asked.join(pages, "page").mapInArrow(_choose(self.shape, percent), f"block long, {_PACK}")
        read = self.table.select("block", "first", "ids", F.col("labels").alias("block_labels"), F.col("vectors").alias("block_vectors"))
        return _best(requests.join(read, "block").mapInArrow(_read(self.shape, percent, most), _FOUND), most)


def mine(rows: DataFrame, anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "vector", positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """Hard negatives of every anchor: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    ``vector`` holds whole numbers (see ``quantised``); the score of two rows is their inner product,
    exact as long as it fits a long. Higher scores come first, ties by least id. An anchor's positives
    are its first other rows of the same label. For each, the first ``negatives`` rows of other labels
    whose score is at least ``percent`` hundredths of the positive's and at most equal count; a
    positive of negative score has none.

    Rows with a null id, label or vector take no part. Rows that repeat an id are rows of their own; an
    anchor is not its own positive, a copy of it is. Shorter vectors end in zeros. Columns that are not
    named do not matter. No rows or no anchors give no rows."""
    spark = rows.sparkSession
    rows = rows.select(
        F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("vector"),
    ).where("id is not null and label is not null and vector is not null")
    rows = materialize(rows, "vectors")
    n, anchors, dims, least, most = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("vector")), F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    if not anchors:
        return spark.createDataFrame([], RESULT)
    blocks = Blocks(rows, Shape(dims, min(least or 0, 0), max(most or 0, 0)), positives)
    anchors = blocks.anchors()
    best = blocks.search(anchors.withColumn("highs", F.array("floor")), None, positives)
    best = materialize(best.select("at", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # the scores of an anchor's positives, at most ``positives`` of them; -1 where there is none
    scores = best.groupBy("at").agg(*(F.max(F.when(F.col("place") == k + 1, F.col("positive_score"))).alias(f"s{k}") for k in range(positives)))
    highs = scores.select("at", F.array(*(F.coalesce(f"s{k}", F.lit(-1).cast("long")) for k in range(positives))).alias("highs"))
    found = blocks.search(anchors.join(highs, "at"), percent, negatives)
    found = found.select("at", (F.col("place") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = best.join(anchors.select("at", F.col("id").alias("anchor_id")), "at")
    return named.join(found, ["at", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
