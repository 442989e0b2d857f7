"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

The most frequent words are in classes by frequency; all other words share one further class, which
is divided into classes of classes down to single words (:mod:`molspark.llm.word_tree`). A word's
probability is that of its class given the context, times that of the word within its class given
the context. All softmaxes add up weights of hashed features of the context: the word before, the
word before that (a skip), and both together. Words that were not learned share one event of the
further class.

Training makes one pass over all learned documents in shards. For each shard Spark sums, per
feature and output, observed and expected counts; their difference is the gradient, and the
expected counts scale its step. Word counts of the whole corpus stay distributed: a bounded head
of them is broadcast, and all rarer words of a document are joined with their counts. The rarer
words have their places in the tree by hash; those that fall on one leaf divide it by their counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molspark.llm.common import slices, words_of
from molspark.llm.fingerprint import mixed
from molspark.llm.word_tree import Sent, Unnamed, WordTree, hash_prefix
from molspark.session import materialize, shuffles_dropped

#: Classes of frequent words and words of a class; one more class holds all other words, in a tree.
CLASSES, SLOTS = 16, 16
OUTPUTS = CLASSES * SLOTS
#: Weights of each of the three kinds of features for classes and their words, and the bias after them.
BUCKETS = 1024
FEATURES = 3 * BUCKETS + 1
#: Most frequent words whose counts every task holds, at most; the others are joined.
HEAD_WORDS = 200_000
#: Shards of the learned documents, one update each.
SHARDS = 3
#: Share of a full diagonal step for each of the three features that act together; counts that
#: damp it; and its bound.
STEP, DAMPING, MOST = 1 / 3, 5.0, 1.0
#: Feature rows, and rows of the tree's weights, that are summed in one group; tasks whose sums meet in
#: one group first; and tasks that sum, for each core.
CHUNK, TREE_CHUNK, FAN_IN, TASKS = 64, 1 << 11, 64, 2
#: Tokens whose counts are added up in single precision.
FOLDED = 1 << 21
#: Words counted in one task before its counts are passed on.
COUNTED = 400_000
#: Text of one numpy step; the arrays of larger ones are new pages of memory each time.
STEP_BYTES = 1 << 17

END = b"\n"
_WIDTH = CLASSES + 1 + OUTPUTS
_ROW = np.uint16 if FEATURES * CLASSES <= 1 << 16 else np.int64
_START = np.uint64(0x5DEECE66D)
_U = np.uint64


def _key(word: bytes) -> bytes:
    """The word, or for a long one a digest that no word can equal (it starts with a blank)."""
    return word if len(word) <= 64 else b" " + xxhash.xxh3_128_digest(word)


def tokens_of(text: bytes | None) -> list[bytes]:
    return [_key(w) if len(w) > 64 else w for w in words_of(text or b"")] + [END]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all tokens of all rows of ``docs`` (text as binary), summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(tokens_of(text))
            if len(seen) >= COUNTED:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model(Sent):
    """``words`` are the head in order of frequency, the first ``OUTPUTS`` of them the outputs. All
    words that occur less than ``least`` times are outside the head."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    classes: np.ndarray  # FEATURES x (CLASSES + 1)
    slots: np.ndarray  # FEATURES x CLASSES x SLOTS
    tree: WordTree  # of the shared class
    least: int = 0

    @staticmethod
    def start(words: list[bytes], counts: np.ndarray, total: int, distinct: int, rest: Unnamed | None = None, least: int = 0) -> Model:
        """Weights that give the smoothed unigram shares, but for words of ``rest``, outside the head,
        whose shares start out equal within a bucket of hashes."""
        top = np.zeros(OUTPUTS)
        top[: min(len(counts), OUTPUTS)] = counts[:OUTPUTS]
        per_class = np.append(top.reshape(CLASSES, SLOTS).sum(1), total - top.sum())
        classes = np.zeros((FEATURES, CLASSES + 1), np.float32)
        slots = np.zeros((FEATURES, CLASSES, SLOTS), np.float32)
        classes[-1] = np.log(per_class + 1.0)
        slots[-1] = np.log(top.reshape(CLASSES, SLOTS) + 1.0)
        tree = WordTree.start(np.asarray(counts[OUTPUTS:], np.float64) + 1, rest or Unnamed.none(), total)
        return Model(words, counts, total, distinct, classes, slots, tree, least)

    @property
    def rare_mass(self) -> float:
        """Mass of the shared class: each known word's count and one, and one for all unknown words
        together."""
        top = min(len(self.words), OUTPUTS)
        return float(self.total - self.counts[:top].sum() + self.distinct - top + 1)


class Reader:
    """Arrays of the tokens of a batch of texts, for one task."""

    def __init__(self, model: Model):
        self.model = model
        self.rank = {w: i for i, w in enumerate(model.words)}
        self.hashes = np.array([_hash(w) for w in model.words], np.uint64)

    def read(self, texts: list[bytes | None]):
        return self.read_all(texts)[:5]

    def read_all(self, texts: list[bytes | None]):
        lists = [tokens_of(t) for t in texts]
        sizes = np.array([len(ws) for ws in lists])
        flat = [w for ws in lists for w in ws]
        ranks = np.fromiter(map(self.rank.get, flat, repeat(-1)), np.int64, len(flat))
        hashes = np.zeros(len(flat), np.uint64)
        known = ranks >= 0
        hashes[known] = self.hashes[ranks[known]]
        rare = np.flatnonzero(~known)
        hashes[rare] = [_hash(flat[i]) for i in rare]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = np.arange(len(flat)) - np.repeat(starts, sizes)
        one = np.where(place >= 1, np.roll(hashes, 1), _START)
        two = np.where(place >= 2, np.roll(hashes, 2), _START)
        contexts = np.stack([_context(one, 1), _context(two, 2), _context(one * _U(31) + mixed(two), 3)])
        features = (contexts & np.uint32(BUCKETS - 1)).astype(np.int64) + np.arange(3)[:, None] * BUCKETS
        return flat, ranks, starts, sizes, features, contexts, hashes

    def leaves(self, ranks: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the shared class and their leaves."""
        shared = np.flatnonzero((ranks < 0) | (ranks >= OUTPUTS))
        return shared, self.model.tree.leaves(np.maximum(ranks[shared] - OUTPUTS, -1), hashes[shared])

    def log_shares(self, ranks: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shares of all classes for each token and of all slots of its class for each output."""
        classes, slots, cls, output = self.sums(ranks, features)
        return _log_softmax(classes), _log_softmax(slots), cls, output

    def sums(self, ranks: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the two softmaxes are taken of."""
        model = self.model
        output = np.flatnonzero((ranks >= 0) & (ranks < OUTPUTS))
        cls = np.full(len(ranks), CLASSES)
        cls[output] = ranks[output] // SLOTS
        classes = np.repeat(model.classes[-1:], len(ranks), 0)
        slots = model.slots[-1][cls[output]]
        by_class = model.slots.reshape(-1, SLOTS)
        for f in features:
            classes += np.take(model.classes, f, axis=0)
            slots += np.take(by_class, f[output] * CLASSES + cls[output], axis=0)
        return classes, slots, cls, output


def _hash(word: bytes) -> int:
    """As Spark's xxhash64."""
    return xxhash.xxh64_intdigest(word, 42)


def _context(hashes: np.ndarray, salt: int) -> np.ndarray:
    return (mixed(hashes + _U(salt)) >> _U(32)).astype(np.uint32)


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials and their sums by row. Sums of weights are logs of counts and a bounded rest, far
    below the largest exponent of a float."""
    shares = np.exp(x)
    return shares, (shares @ np.ones(x.shape[1], x.dtype))[:, None]


def _log_softmax(x: np.ndarray) -> np.ndarray:
    return x - np.log(_exp(x)[1])


def _softmax(x: np.ndarray) -> np.ndarray:
    shares, total = _exp(x)
    shares /= total
    return shares


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the sums of their values."""
    if not len(rows):
        return rows, values
    # rows of both kinds of weights fit 16 bits, which numpy sorts by counting
    order = np.argsort(rows.astype(_ROW), kind="stable")
    ordered = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[starts], np.add.reduceat(np.take(values, order, axis=0), starts, axis=0)


class _Sums:
    """Observed and expected counts of one task, by class, by slot, and by part of the tree's classes.
    New ones are folded into the totals while they are still exact."""

    def __init__(self) -> None:
        shapes = (FEATURES, CLASSES + 1), (FEATURES * CLASSES, SLOTS)
        self.observed, self.expected = ([np.zeros(shape, np.float32) for shape in shapes] for _ in range(2))
        self.totals: list[np.ndarray] = []
        self.tokens = 0

    def fold(self) -> None:
        new = [*self.observed, *self.expected]
        self.totals = self.totals or [np.zeros(n.shape) for n in new]
        for total, n in zip(self.totals, new, strict=True):
            total += n
            n[:] = 0
        self.tokens = 0

    @property
    def gradient(self) -> list[np.ndarray]:
        self.fold()
        half = len(self.totals) // 2
        return [o - e for o, e in zip(self.totals[:half], self.totals[half:], strict=True)]

    def add(self, reader: Reader, texts: list[bytes | None]) -> None:
        _, ranks, _, _, features, contexts, hashes = reader.read_all(texts)
        classes, slots, cls, output = reader.sums(ranks, features)
        p, q = _softmax(classes), _softmax(slots)
        own, slot = cls[output], ranks[output] % SLOTS
        self._add(0, np.full(len(cls), FEATURES - 1), cls, [FEATURES - 1], p.sum(0))
        for f in features:
            self._add(0, f, cls, *_by_row(f, p))
        for f in (*(f[output] for f in features), FEATURES - 1):
            row = f * CLASSES + own
            self._add(1, row, slot, *_by_row(row, q))
        if len(self.observed) == 2:
            for counts in (self.observed, self.expected):
                counts.append(np.zeros_like(reader.model.tree.weights))
        shared, leaf = reader.leaves(ranks, hashes)
        reader.model.tree.add(leaf, hashes[shared], contexts[:, shared], self.observed[2], self.expected[2])
        self.tokens += len(ranks)
        if self.tokens >= FOLDED:
            self.fold()

    def _add(self, kind: int, rows: np.ndarray, own: np.ndarray, at: np.ndarray, expected: np.ndarray) -> None:
        np.add.at(self.observed[kind].reshape(-1), rows * self.observed[kind].shape[1] + own, np.float32(1))
        self.expected[kind][at] += expected

    def chunks(self) -> Iterator[tuple[int, bytes]]:
        """(chunk, sums): gradient and expected counts of ``CHUNK`` feature rows in one buffer, then those
        of ``TREE_CHUNK`` rows of the tree's weights."""
        *flat, deep = self.gradient
        *expected, deep_expected = self.totals[3:]
        wide = np.hstack([a.reshape(FEATURES, -1) for a in (*flat, *expected)]).astype(np.float32)
        tall = np.stack([deep, deep_expected]).astype(np.float32)
        buffers = [wide[start : start + CHUNK].tobytes() for start in range(0, FEATURES, CHUNK)]
        buffers += [tall[:, start : start + TREE_CHUNK].tobytes() for start in range(0, len(deep), TREE_CHUNK)]
        yield from enumerate(buffers)


def _sum_chunks(key: tuple, batches: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(batches["sums"].iloc[0]) // 4, np.float64)
    for buffer in batches.sort_values("part")["sums"]:
        total += np.frombuffer(buffer, np.float32)
    return pd.DataFrame({"chunk": [key[0]], "part": [int(key[-1]) if len(key) > 1 else 0], "sums": [total.astype(np.float32).tobytes()]})


def _update(model: Model, docs: DataFrame) -> Model:
    """One step on all rows of ``docs``; sums of tasks meet in groups of ``FAN_IN`` first, and the
    driver gets one array of the model's size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, reader, part = _Sums(), None, TaskContext.get().partitionId()
        for batch in slices(batches, STEP_BYTES):
            reader = reader or Reader(shared.value)
            sums.add(reader, batch.column(0).to_pylist())
        if reader:
            numbers, buffers = zip(*sums.chunks(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int32()), pa.array([part] * len(numbers), pa.int32()), pa.array(buffers, pa.binary())], ["chunk", "part", "sums"]
            )

    schema = "chunk int, part int, sums binary"
    tasks = TASKS * docs.sparkSession.sparkContext.defaultParallelism
    with shuffles_dropped(docs.sparkSession):
        partial = docs.select("text").coalesce(tasks).mapInArrow(run, schema)
        first = partial.groupBy("chunk", F.floor(F.col("part") / FAN_IN).alias("fan")).applyInPandas(_sum_chunks, schema)
        second = first.groupBy("chunk").applyInPandas(_sum_chunks, schema)
        rows = sorted((r["chunk"], r["sums"]) for r in second.collect())
    shared.unpersist()
    if not rows:
        return model
    flat = -(-FEATURES // CHUNK)
    wide = np.vstack([np.frombuffer(buffer, np.float32).reshape(-1, 2 * _WIDTH) for _, buffer in rows[:flat]]).astype(np.float64)
    step = np.clip(STEP * wide[:, :_WIDTH] / (wide[:, _WIDTH:] + DAMPING), -MOST, MOST).astype(np.float32)
    step[-1] = 0  # the biases are the unigram shares from the start
    classes = model.classes + step[:, : CLASSES + 1]
    slots = model.slots + step[:, CLASSES + 1 :].reshape(model.slots.shape)
    deep = np.concatenate([np.frombuffer(buffer, np.float32).reshape(2, -1) for _, buffer in rows[flat:]], axis=1).astype(np.float64)
    turn = np.clip(STEP * deep[0] / (deep[1] + DAMPING), -MOST, MOST).astype(np.float32)
    return replace(model, classes=classes, slots=slots, tree=model.tree.moved(turn.reshape(model.tree.weights.shape)))


def _head_count(counts: DataFrame) -> int:
    """The least count of head words: at most ``HEAD_WORDS`` words have it or more. Words are
    counted by steps of their count, so no task sends words that the head does not take."""
    step = F.floor(F.log2("n") * 64).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    least, words = 1 << 62, 0
    for row in sorted(steps, key=lambda r: -r["step"]):
        words += row["words"]
        if words > HEAD_WORDS:
            break
        least = row["least"]
    return least


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the table (word, n) of all word counts, from all rows (doc_id, text)."""
    rows = docs.select(F.xxhash64("doc_id").alias("h"), F.col("text").cast("binary").alias("text"))
    counts = materialize(count_words(rows), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = _head_count(counts)
    head = sorted(counts.where(F.col("n") >= least).collect(), key=lambda r: (-r["n"], bytes(r["word"])))
    rest = Unnamed.of(counts.where(F.col("n") < least), distinct - len(head))
    model = Model.start([bytes(r["word"]) for r in head], np.array([r["n"] for r in head], np.int64), total, distinct, rest, least)
    for shard in range(SHARDS):
        model = _update(model, rows.where(F.pmod("h", F.lit(SHARDS)) == shard))
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, held_out, text): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    Null and empty texts have the end token alone. A model without words gives every token the
    shared class. Rows are told apart by a number of their own, so repeated and null ids repeat
    their results; an empty table gives an empty one; other columns are ignored.
    """
    rows = docs.select("doc_id", "held_out", F.col("text").cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_tokens", "n_head", "n_rare", "head_logs", "model_logs", "tail"]
    types = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.list_(pa.struct([("word", pa.binary()), ("log", pa.float64())]))]
    word = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("log", T.DoubleType())])
    schema = T.StructType([rows.schema["doc_id"], rows.schema["held_out"]])
    for name in names:
        schema.add(name, "long" if name.startswith("n_") else "double" if name != "tail" else T.ArrayType(word))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in slices(batches, STEP_BYTES):
            reader = reader or Reader(shared.value)
            flat, ranks, starts, sizes, features, contexts, hashes = reader.read_all(batch.column(2).to_pylist())
            classes, slots, cls, output = reader.log_shares(ranks, features)
            logs = classes[np.arange(len(cls)), cls].astype(np.float64)
            logs[output] += slots[np.arange(len(output)), ranks[output] % SLOTS]
            within = np.zeros(len(flat))
            deep, leaf = reader.leaves(ranks, hashes)
            within[deep] = reader.model.tree.logs(leaf, hashes[deep], contexts[:, deep])
            head = ranks >= 0
            own = np.zeros(len(flat))
            own[head] = np.log10(reader.model.counts[ranks[head]] + 1.0)
            rare = cls == CLASSES
            sums = [np.add.reduceat(v, starts) for v in (head.astype(np.int64), rare.astype(np.int64), own, (logs + np.where(head, within, 0.0)) / np.log(10))]
            tail = np.flatnonzero(~head)
            borders = np.searchsorted(tail, np.append(starts, len(flat))).astype(np.int32)
            pairs = [pa.array([flat[i] for i in tail], pa.binary()), pa.array(within[tail] / np.log(10))]
            lists = pa.ListArray.from_arrays(pa.array(borders), pa.StructArray.from_arrays(pairs, ["word", "log"]))
            arrays = [pa.array(v, t) for v, t in zip([sizes, *sums], types[:-1], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays, lists], ["doc_id", "held_out", *names])

    read = materialize(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-read")
    tail = read.select("row", F.explode("tail").alias("t")).groupBy("row", F.col("t.word").alias("word")).agg(
        F.count("*").alias("times"), F.sum("t.log").alias("logs")
    )
    # words on one leaf divide it by their counts
    leaf = Window.partitionBy(hash_prefix(F.col("word"), model.tree.leaf_bits))
    rest = counts.where(F.col("n") < model.least).withColumn("share", F.log10((F.col("n") + 1) / F.sum(F.col("n") + 1).over(leaf)))
    found = tail.join(rest, "word").groupBy("row").agg(
        F.sum("times").alias("tail_known"),
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("tail_logs"),
        F.sum(F.col("logs") + F.col("times") * F.col("share")).alias("tail_model"),
    )
    joined = read.drop("tail").join(found, "row", "left").fillna(0, ["tail_known", "tail_logs", "tail_model"])
    n_known = (F.col("n_head") + F.col("tail_known")).cast("long")
    unknown = F.col("n_tokens") - n_known
    base = np.log10(model.total + model.distinct + 1.0)
    known_share = np.log10(max(model.rare_mass - 1, 1) / model.rare_mass)
    return joined.select(
        "doc_id", "held_out", "n_tokens",
        n_known.alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("head_logs") + F.col("tail_logs") - F.col("n_tokens") * float(base)).alias("base_score"),
        (F.col("model_logs") + F.col("tail_model") + (F.col("n_rare") - unknown) * float(known_share) - unknown * float(np.log10(model.rare_mass))).alias("score"),
    )
