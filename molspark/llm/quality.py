"""Quality scores: kernel ridge regression on statistics of a document, calibrated to probabilities.

A document becomes some two dozen statistics of its whole text: shares of kinds of bytes, lengths,
repetition of words, word pairs and lines. Random Fourier features approximate a Gaussian kernel over
them. Every task adds up its part of the normal equations, separately for a few folds; the sums are
added in a fixed order, and only they reach the driver, whose size follows the number of features.
Leaving a fold out is a subtraction, so the ridge and out-of-fold scores cost no further fits over the
rows. Isotonic regression on out-of-fold scores, counted in fine bins, turns scores into probabilities.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molspark.llm.common import slices

#: Random features; folds; candidates for the ridge, as shares of the number of rows.
FEATURES = 512
FOLDS = 4
RIDGES = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1)
SEED = 12
#: Rows of the normal equations that travel together.
CHUNK = 64
#: Scores are counted in bins of this width between these ends before calibration.
BIN, LEAST, MOST = 1 / 2048, -0.5, 1.5

_KINDS = ("lower", "upper", "digit", "blank", "newline", "stop", "pause", "symbol", "control", "beyond")
STATISTICS = (
    *_KINDS, "bytes", "words", "word_bytes", "distinct_words", "top_word", "echoes", "distinct_pairs", "short_words", "long_words",
    "lettered_words", "word_spread", "lines", "distinct_lines", "line_bytes",
)


def _kind_table() -> np.ndarray:
    kinds = np.full(256, _KINDS.index("control"))
    for chars, kind in ((b" \t", "blank"), (b"\n\r", "newline"), (b".!?", "stop"), (b",;:'\"()-", "pause"), (b"#$%&*+/<=>@[\\]^_`{|}~", "symbol")):
        kinds[list(chars)] = _KINDS.index(kind)
    for first, last, kind in ((97, 122, "lower"), (65, 90, "upper"), (48, 57, "digit"), (128, 255, "beyond")):
        kinds[first : last + 1] = _KINDS.index(kind)
    return kinds


_KIND_OF = _kind_table()
_NO_LETTER = bytes(b for b in range(128) if not chr(b).isalpha())


def statistics(text: bytes) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``; zeros for an empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    kinds = np.zeros(len(_KINDS))
    for start in range(0, len(text), 1 << 20):
        kinds += np.bincount(_KIND_OF[np.frombuffer(text, np.uint8, min(1 << 20, len(text) - start), start)], minlength=len(_KINDS))
    words, lines = text.split(), [line for line in text.split(b"\n") if line.strip()]
    n, m = max(len(words), 1), max(len(lines), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False))) / max(len(words) - 1, 1)
    lettered = sum(count for word, count in counts.items() if word.translate(None, _NO_LETTER)) / n
    return [
        *(kinds / len(text)), math.log1p(len(text)), math.log1p(len(words)), math.log1p(lengths.mean()), len(counts) / n,
        max(counts.values(), default=0) / n, sum(map(bytes.__eq__, words, words[1:])) / n, pairs, float((lengths < 3).mean()),
        float((lengths > 15).mean()), lettered, math.log1p(lengths.std()), math.log1p(len(lines)), len(set(lines)) / m,
        math.log1p(sum(map(len, lines)) / m),
    ]


def with_statistics(docs: DataFrame, text: str = "text", stats: str = "stats") -> DataFrame:
    """``docs`` with the statistics (array of double) in place of the text; null counts as empty."""
    kept = [name for name in docs.columns if name not in (text, stats)]
    source = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).cast("binary").alias(stats))
    schema = docs.select(*kept, F.array(F.lit(0.0)).alias(stats)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [statistics(text.as_py()) for text in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], batch.schema.names)

    return source.mapInArrow(run, schema)


@dataclass(frozen=True)
class Model:
    """Scales of the statistics, weights of the random features, and steps to probabilities."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # one column a fold left out, the last with all rows
    knots: np.ndarray
    levels: np.ndarray

    def probability(self, scores: np.ndarray) -> np.ndarray:
        return np.interp(scores, self.knots, self.levels)


def random_directions(dims: int, features: int = FEATURES, seed: int = SEED):
    """Frequencies and phases; the bandwidth of the kernel is the root of the number of statistics."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(dims, features)) / math.sqrt(dims), rng.uniform(0, 2 * math.pi, features)


def fourier(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray, features: int) -> np.ndarray:
    """Random Fourier features of standardised rows, and a constant: their products approximate
    exp(-|x - y|^2 / (2 * dims)) + 1."""
    frequencies, phases = random_directions(rows.shape[1], features)
    out = np.empty((len(rows), features + 1))
    out[:, :-1] = np.cos(((rows - mean) / scale) @ frequencies + phases) * math.sqrt(2 / features)
    out[:, -1] = 1.0
    return out


def _stats_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(batch.num_rows, -1)


_SUMS = "fold int, chunk int, part int, sums binary"


def normal_equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, folds: int = FOLDS) -> np.ndarray:
    """Sums by fold over rows (fold, stats, target): an array (folds, features + 2, features + 2) of
    products of the features, the constant and, last, the target. Tasks send their own sums, cut in
    chunks of rows; the chunks of one place are added in the order of the tasks."""
    size = features + 2

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((folds, size, size)), False
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                some = batch.slice(start, 2048)
                fold = some.column("fold").to_numpy()
                whole = np.empty((some.num_rows, size))
                whole[:, :-1] = fourier(_stats_of(some, "stats"), mean, scale, features)
                whole[:, -1] = some.column("target").to_numpy()
                for k in range(folds):
                    total[k] += whole[fold == k].T @ whole[fold == k]
                seen = True
        if seen:
            part = TaskContext.get().partitionId()
            for k in range(folds):
                for chunk, first in enumerate(range(0, size, CHUNK)):
                    row = [[k], [chunk], [part], [total[k, first : first + CHUNK].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["fold", "chunk", "part", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = None, None

        def row():
            values = [[place[0]], [place[1]], [0], [total.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["fold", "chunk", "part", "sums"])

        for batch in batches:
            for k, chunk, sums in zip(batch.column("fold").to_pylist(), batch.column("chunk").to_pylist(), batch.column("sums"), strict=True):
                own = np.frombuffer(sums.as_py())
                if place == (k, chunk):
                    total += own
                else:
                    if place is not None:
                        yield row()
                    place, total = (k, chunk), own.copy()
        if place is not None:
            yield row()

    sums = rows.select("fold", "stats", "target").mapInArrow(of_task, _SUMS)
    sums = sums.repartition("fold", "chunk").sortWithinPartitions("fold", "chunk", "part").mapInArrow(added, _SUMS)
    out = np.zeros((folds, size, size))
    for row in sums.collect():  # folds x (features + 2) squared numbers, whatever the number of rows
        block = np.frombuffer(row.sums).reshape(-1, size)
        out[row.fold, row.chunk * CHUNK : row.chunk * CHUNK + len(block)] = block
    return out


def ridge_weights(sums: np.ndarray) -> np.ndarray:
    """Weights by columns: each fold left out in turn, then none. The ridge is the one of ``RIDGES``
    with the least squared error over the folds left out."""
    total = sums.sum(axis=0)

    def solve(part, ridge):
        gram = part[:-1, :-1] + np.diag([max(part[-2, -2], 1.0) * ridge] * (len(part) - 2) + [1e-9])
        return np.linalg.solve(gram, part[:-1, -1])

    tried = []
    for ridge in RIDGES:
        weights = [solve(total - fold, ridge) for fold in sums]
        errors = [fold[-1, -1] - 2 * w @ fold[:-1, -1] + w @ fold[:-1, :-1] @ w for w, fold in zip(weights, sums, strict=True)]
        tried.append((sum(errors), ridge, weights))
    _, ridge, weights = min(tried, key=lambda x: x[:2])
    return np.column_stack([*weights, solve(total, ridge)])


def isotonic(x: np.ndarray, mean: np.ndarray, weight: np.ndarray):
    """Non-decreasing least squares by pooled neighbours: the centres and levels of its steps."""
    blocks: list[list[float]] = []
    for at, level, mass in zip(x, mean, weight, strict=True):
        blocks.append([at * mass, level * mass, mass])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(labelled: DataFrame, features: int = FEATURES) -> Model:
    """Model of rows (id, stats, target), target 0 or 1, all of them; rows with another or a null
    target, or null statistics, are left out. An id may have several rows. Without rows, scores are 0.5."""
    dims = len(STATISTICS)
    target = F.col("target").cast("double")
    rows = labelled.where(target.isin(0.0, 1.0) & F.col("stats").isNotNull())
    rows = rows.select(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(FOLDS)).cast("int").alias("fold"), "stats", target.alias("target"))
    moments = rows.agg(F.count("*"), *(f(F.element_at("stats", i + 1)) for i in range(dims) for f in (F.avg, F.stddev_pop))).first()
    if not moments[0]:
        return Model(np.zeros(dims), np.ones(dims), np.zeros((features + 1, FOLDS + 1)), np.array([0.0]), np.array([0.5]))
    mean, scale = np.array(moments[1::2]), np.array(moments[2::2])
    scale = np.where(scale > 1e-9, scale, 1.0)
    weights = ridge_weights(normal_equations(rows, mean, scale, features))

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = fourier(_stats_of(batch, "stats"), mean, scale, features) @ weights
            own = scores[np.arange(batch.num_rows), batch.column("fold").to_numpy()]
            bins = np.floor(np.clip(own, LEAST, MOST) / BIN).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("target")], ["bin", "target"])

    bins = rows.mapInArrow(left_out, "bin int, target double").groupBy("bin").agg(F.avg("target"), F.count("*")).orderBy("bin").collect()
    at, level, mass = (np.array(x, float) for x in zip(*bins, strict=True))  # at most (MOST - LEAST) / BIN + 1 of them
    knots, levels = isotonic((at + 0.5) * BIN, level, mass)
    return Model(mean, scale, weights, knots, levels)


def score(rows: DataFrame, model: Model, stats: str = "stats", score: str = "score") -> DataFrame:
    """``rows`` with the probability of target 1 in place of the statistics."""
    kept = [name for name in rows.columns if name not in (stats, score)]
    schema = rows.select(*kept, F.lit(0.0).alias(score)).schema
    features = len(model.weights) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = fourier(_stats_of(batch, stats), model.mean, model.scale, features) @ model.weights[:, -1]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), pa.array(model.probability(raw))], [*kept, score])

    return rows.select(*kept, stats).mapInArrow(run, schema)
