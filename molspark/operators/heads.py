"""Regression heads over a vector column: fitting, scoring and trial-parallel tuning."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molspark.functions import mlp
from molspark.functions.hashing import seeded_hash
from molspark.functions.vectors import dot
from molspark.operators.checks import require_columns
from molspark.operators.ranking import head_by_hash


# Parameters per row in which the tasks of a training step report.
_CHUNK = 512
# Partitions whose reports meet in one group first.
_FAN_IN = 256
_PARTIAL = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("value", pa.list_(pa.float64()))])


@dataclass(frozen=True)
class HeadParams:
    """``batch_size=None`` takes one exact full gradient per epoch instead of mini-batches."""

    num_hidden_layers: int = 2
    dropout: float = 0.1
    learning_rate: float = 1e-3
    batch_size: int | None = 32
    epochs: int = 10
    warmup: float = 0.1
    seed: int = 42


@dataclass(frozen=True)
class Head:
    """A fitted head: its flat parameters and the training and validation loss per epoch."""

    dim: int
    num_hidden_layers: int
    weights: np.ndarray = field(repr=False)
    history: tuple[float, ...] = ()
    eval_history: tuple[float, ...] = ()
    best_epoch: int | None = None


class Predictor(Protocol):
    """User hook of :func:`score_with`: a picklable object that scores blocks of rows."""

    def predict(self, rows: pd.DataFrame) -> pd.Series: ...


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if (np.diff(column.offsets.to_numpy()) != dim).any():
        raise ValueError(f"every vector must have {dim} entries")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype("f8")


def _training_rows(df: DataFrame, key: str, vector: str, label: str, partitions: int) -> DataFrame:
    """Labelled rows in a layout that a retried task reproduces: hashed, then ordered by hash."""
    return (
        df.filter(F.col(vector).isNotNull() & F.col(label).isNotNull())
        .select(
            seeded_hash(key).alias("_h"),
            F.col(vector).alias("x"),
            F.col(label).cast("double").alias("y"),
        )
        .repartition(partitions, "_h")
        .sortWithinPartitions("_h")
        .select("x", "y")
    )


def _summed(data: DataFrame, task: Callable[[Iterable], tuple[int, float, np.ndarray]], size: int):
    """Run ``task`` on each partition and return (rows, loss, vector) summed over all of them.

    The vector of a partition travels in chunks and Spark brings equal chunks together, first
    those of ``_FAN_IN`` partitions and then their sums, so a task adds up ``_CHUNK`` numbers for
    each of a bounded share of the partitions, however many parameters there are. They are added
    in partition order, which makes the sums repeatable. The driver gets the sums.
    """

    def emit(batches):
        from pyspark import TaskContext

        n, loss, vector = task(batches)
        if n:
            part = TaskContext.get().partitionId()
            values = np.concatenate([[n, loss], vector])
            chunks = [values[i : i + _CHUNK] for i in range(0, len(values), _CHUNK)]
            yield pa.RecordBatch.from_pydict(
                {"chunk": list(range(len(chunks))), "part": [part] * len(chunks), "value": chunks}, _PARTIAL
            )

    def add(partials: pa.Table) -> pa.Table:
        partials = partials.sort_by("part").combine_chunks()
        values = partials.column("value").combine_chunks().flatten().to_numpy().reshape(partials.num_rows, -1)
        first = partials.slice(0, 1).to_pydict()
        return pa.Table.from_pydict({**first, "value": [values.sum(axis=0)]}, _PARTIAL)

    schema = "chunk int, part int, value array<double>"
    some = F.floor(F.col("part") / _FAN_IN).alias("some")
    partial = data.mapInArrow(emit, schema).groupBy("chunk", some).applyInArrow(add, schema)
    sums = partial.groupBy("chunk").applyInArrow(add, schema)
    table = sums.toArrow().sort_by("chunk")
    if not table.num_rows:
        return 0, 0.0, np.zeros(size)
    totals = table.column("value").combine_chunks().flatten().to_numpy()
    return int(totals[0]), float(totals[1]), totals[2:]


def gradient_sums(data: DataFrame, weights: np.ndarray, dim: int, layers: int, dropout: float = 0.0, seed=(0,)):
    """(rows, squared error, gradient) over all rows of a frame with columns x and y. Dropout masks
    come from the seed and the partition, so a retried task repeats them."""

    def task(batches):
        from pyspark import TaskContext

        rng = np.random.default_rng([*seed, TaskContext.get().partitionId()])
        n, loss, total = 0, 0.0, np.zeros(len(weights))
        for batch in batches:
            x, y = _matrix(batch.column("x"), dim), batch.column("y").to_numpy()
            block_loss, block = mlp.squared_error_gradient(weights, x, y, layers, dropout, rng)
            n, loss, total = n + len(y), loss + block_loss, total + block
        return n, loss, total

    return _summed(data, task, len(weights))


def mean_squared_error(data: DataFrame, weights: np.ndarray, dim: int, layers: int) -> float:
    """Loss of given parameters over a frame with columns x and y, summed per partition."""

    def task(batches):
        n, loss = 0, 0.0
        for batch in batches:
            x, y = _matrix(batch.column("x"), dim), batch.column("y").to_numpy()
            error = mlp.predict(weights, x, layers) - y
            n, loss = n + len(y), loss + float(error @ error)
        return n, loss, np.empty(0)

    n, loss, _ = _summed(data, task, 0)
    return loss / n if n else float("nan")


def _local_epoch(data, state, step, total_steps, dim, p: HeadParams, epoch):
    """One pass of mini-batch Adam per partition; the states are averaged by rows afterwards."""

    def task(batches):
        from pyspark import TaskContext

        flat, m, v = np.split(state.copy(), 3)
        rng = np.random.default_rng([p.seed, epoch, TaskContext.get().partitionId()])
        n, loss, at = 0, 0.0, step
        for batch in batches:
            xs, ys = _matrix(batch.column("x"), dim), batch.column("y").to_numpy()
            for i in range(0, len(ys), p.batch_size):
                x, y = xs[i : i + p.batch_size], ys[i : i + p.batch_size]
                at += 1
                block_loss, grad = mlp.squared_error_gradient(flat, x, y, p.num_hidden_layers, p.dropout, rng)
                rate = mlp.linear_schedule(at, total_steps, p.learning_rate, p.warmup)
                flat, m, v = mlp.adam_step(flat, m, v, at, grad / len(y), rate)
                n, loss = n + len(y), loss + block_loss
        return n, loss, np.concatenate([flat, m, v]) * n

    n, loss, summed = _summed(data, task, len(state))
    return summed / max(n, 1), loss / max(n, 1)


def fit_head(
    df: DataFrame,
    key: str,
    vector: str,
    label: str,
    params: HeadParams | None = None,
    val: DataFrame | None = None,
    partitions: int | None = None,
) -> Head:
    """Fit a head with GELU layers by data-parallel training; one Spark job per epoch.

    The (vector, label) projection is laid out and cached once. In an epoch every task
    trains on its partition in mini-batches from the shared parameters, and the results
    are averaged, weighted by rows; with ``batch_size=None`` the tasks return exact
    gradients instead. With ``val`` the loss on that table is taken after every epoch and
    the parameters of the best epoch (the first, on a tie) are returned. Only parameters,
    never rows, reach the driver. Rows without label or vector are left out. Masks and
    order come from the seed, so a retried task repeats its work; they are not those of any
    other library.
    """
    p = params or HeadParams()
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    data, *checked = (
        _training_rows(frame, key, vector, label, partitions).persist() for frame in (df, val) if frame is not None
    )
    try:
        shape = data.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim")).first()
        if not shape["n"]:
            raise ValueError("no row has both a vector and a label")
        dim, layers = shape["dim"], p.num_hidden_layers
        flat = mlp.init_parameters(dim, layers, p.seed)
        state, history, evals = np.concatenate([flat, np.zeros(2 * len(flat))]), [], []
        best = None
        steps = -(-shape["n"] // (partitions * p.batch_size)) if p.batch_size else 1
        for epoch in range(p.epochs):
            if p.batch_size:
                state, loss = _local_epoch(data, state, epoch * steps, p.epochs * steps, dim, p, epoch)
            else:
                state, loss = _full_step(data, state, dim, p, epoch)
            history.append(float(loss))
            if checked:
                evals.append(mean_squared_error(checked[0], np.split(state, 3)[0], dim, layers))
                if best is None or evals[-1] < evals[best[0]]:
                    best = epoch, np.split(state, 3)[0]
    finally:
        for frame in (data, *checked):
            frame.unpersist()
    epoch, weights = best or (None, np.split(state, 3)[0])
    return Head(dim, layers, weights, tuple(history), tuple(evals), epoch)


def _full_step(data, state, dim, p: HeadParams, epoch):
    """One Adam step with the exact gradient over all rows."""
    flat, m, v = np.split(state, 3)
    n, loss, grad = gradient_sums(data, flat, dim, p.num_hidden_layers, p.dropout, (p.seed, epoch))
    rate = mlp.linear_schedule(epoch + 1, p.epochs, p.learning_rate, p.warmup)
    return np.concatenate(mlp.adam_step(flat, m, v, epoch + 1, grad / n, rate)), loss / n


def fit_linear_head(df: DataFrame, vector: str, label: str, ridge: float = 0.0) -> Head:
    """Head without hidden layers, by the normal equations of Spark's own regression."""
    rows = df.filter(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(
        array_to_vector(F.col(vector).cast("array<double>")).alias("features"),
        F.col(label).cast("double").alias("label"),
    )
    model = LinearRegression(solver="normal", regParam=ridge, standardization=False).fit(rows)
    weights = np.append(model.coefficients.toArray(), model.intercept)
    return Head(len(weights) - 1, 0, weights)


def fit_lines(df: DataFrame, x: str, y: str, by: str | list[str] | None = None) -> DataFrame:
    """(slope, intercept) of the least-squares line, per group if ``by`` is given; one aggregation."""
    keys = [] if by is None else [by] if isinstance(by, str) else by
    line = [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")]
    return df.groupBy(*keys).agg(*line)


def fit_line(df: DataFrame, x: str, y: str) -> tuple[float, float]:
    row = fit_lines(df, x, y).first()
    return row["slope"], row["intercept"]


def score(vector: str | Column, head: Head) -> Column:
    """Prediction of one head for a vector column; null for a null vector.

    A linear head is a plain expression. Otherwise only the vector column crosses to
    Python, in Arrow batches; all other columns, labels included, stay in the row.
    """
    column = F.col(vector) if isinstance(vector, str) else vector
    if head.num_hidden_layers == 0:
        return dot(column, head.weights[:-1].tolist(), float(head.weights[-1]))
    return score_all(column, {"y_pred": head})[0]


def score_all(vector: str | Column, heads: dict[str, Head]) -> Column:
    """``array<double>`` with the prediction of each head, in order; one Arrow pass for all."""
    column = F.col(vector) if isinstance(vector, str) else vector
    models = tuple(heads.values())

    def run(vectors: pa.Array) -> pa.Array:
        kept = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        out = np.full((len(vectors), len(models)), np.nan)
        if len(kept):
            x = _matrix(vectors.drop_null(), models[0].dim)
            for j, head in enumerate(models):
                out[kept, j] = mlp.predict(head.weights, x, head.num_hidden_layers)
        offsets = pa.array(np.arange(len(vectors) + 1, dtype="i4") * len(models))
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), from_pandas=True))

    return F.arrow_udf(run, "array<double>")(column)


def score_properties(df: DataFrame, vector: str, heads: dict[str, Head]) -> DataFrame:
    """One row per input row and property: (..., property, value); rows are not shuffled."""
    names = F.array(*[F.lit(n) for n in heads])
    scored = df.withColumn("_values", score_all(vector, heads))
    pairs = F.explode(F.arrays_zip(names.alias("property"), F.col("_values").alias("value")))
    return scored.withColumn("_p", pairs).select(*df.columns, "_p.property", "_p.value")


class MapPredictor:
    """Adapter for a model whose ``predict`` takes a list of inputs and returns, for each, a map
    from property to ``{"value": number}``; the number of the first property is the prediction."""

    def __init__(self, model):
        self.model = model

    def predict(self, rows: pd.DataFrame) -> pd.Series:
        found = self.model.predict(rows.iloc[:, 0].tolist())
        return pd.Series([next(iter(f.values()))["value"] if f else None for f in found], dtype="f8")


def score_with(df: DataFrame, predictor: Predictor, inputs: list[str], name: str = "y_pred") -> DataFrame:
    """Add the predictions of a user object, called on Arrow batches of the named columns."""
    require_columns(df, inputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for rows in batches:
            rows.columns = inputs
            yield predictor.predict(rows).astype("f8")

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    return df.withColumn(name, F.pandas_udf(run, "double")(F.struct(*inputs)))


def map_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a user function to Arrow batches of rows; select columns before calling this."""

    def run(batches):
        for rows in batches:
            yield fn(rows)

    return df.mapInPandas(run, schema)


def _trial_list(trials: DataFrame, max_trials: int) -> list[dict]:
    rows = [r.asDict() for r in trials.limit(max_trials + 1).collect()]
    if len(rows) > max_trials:
        raise ValueError(f"more than {max_trials} trials")
    if len({r["trial_id"] for r in rows}) != len(rows) or any(r["trial_id"] is None for r in rows):
        raise ValueError("trial_id must be unique and not null")
    return sorted(rows, key=lambda r: r["trial_id"])


def _trial_epoch(data: DataFrame, trials: list[dict], states: list[np.ndarray], dim: int, epoch: int, epochs: int, rows: int, seed: int):
    """One pass of mini-batch Adam per partition for every trial, in one job over the rows; each
    trial's states are averaged by rows afterwards."""
    borders = np.cumsum([0, *map(len, states)])

    def task(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own = [np.split(state.copy(), 3) for state in states]
        rngs = [np.random.default_rng([seed, epoch, part, int(t["trial_id"])]) for t in trials]
        n, done = 0, [0] * len(trials)
        for batch in batches:
            xs, ys = _matrix(batch.column("x"), dim), batch.column("y").to_numpy()
            n += len(ys)
            for k, trial in enumerate(trials):
                size, layers = int(trial["batch_size"]), int(trial["num_hidden_layers"])
                steps = max(1, -(-rows // size))
                for i in range(0, len(ys), size):
                    x, y = xs[i : i + size], ys[i : i + size]
                    done[k] += 1
                    at = epoch * steps + done[k]
                    _, grad = mlp.squared_error_gradient(own[k][0], x, y, layers, float(trial["dropout"]), rngs[k])
                    rate = mlp.linear_schedule(at, epochs * steps, float(trial["learning_rate"]), 0.0)
                    own[k] = list(mlp.adam_step(*own[k], at, grad / len(y), rate))
        return n, 0.0, np.concatenate([np.concatenate(state) for state in own]) * n

    n, _, summed = _summed(data, task, int(borders[-1]))
    return [summed[a:b] / max(n, 1) for a, b in zip(borders[:-1], borders[1:])]


def _mean_losses(data: DataFrame, count: int, dim: int, losses: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> np.ndarray:
    """Means over all rows of ``count`` losses that ``losses`` gives per row of a block."""

    def task(batches):
        n, total = 0, np.zeros(count)
        for batch in batches:
            x, y = _matrix(batch.column("x"), dim), batch.column("y").to_numpy()
            n, total = n + len(y), total + [float(np.sum(rows)) for rows in losses(x, y)]
        return n, 0.0, total

    n, _, summed = _summed(data, task, count)
    return summed / n if n else np.full(count, np.nan)


def sweep(
    trials: DataFrame,
    train: DataFrame,
    val: DataFrame,
    key: str,
    vector: str,
    label: str,
    objective: Callable[[dict, np.ndarray, np.ndarray], np.ndarray] | None = None,
    max_train: int | None = None,
    epochs: int = 3,
    seed: int = 42,
    max_trials: int = 1000,
) -> DataFrame:
    """Trials table with the objective of each trial in ``value``.

    All trials share each pass: an epoch is one job over the cached train rows in which every
    task trains every trial on its partition, and the results are averaged by rows. The value is
    the mean squared error over the whole validation side, taken for all trials in one job. Each
    trial starts from fresh parameters and draws from its own seed, so its value depends on its
    own parameters only. ``max_train`` bounds the rows that are fitted on, by default none are
    left out; ``max_trials`` bounds the trials, whose parameters are what the driver holds.

    A user ``objective`` replaces the training: it gets a trial's parameters and a block of
    validation vectors and labels and returns a loss per row; the value is their mean.
    """
    spark = trials.sparkSession
    rows = _trial_list(trials, max_trials)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    checked = _training_rows(val, key, vector, label, partitions).persist()
    data = None
    try:
        dim = checked.agg(F.max(F.size("x"))).first()[0]
        if dim is None:
            raise ValueError("both sides need labelled rows")
        if objective is not None:
            values = _mean_losses(checked, len(rows), dim, lambda x, y: [objective(t, x, y) for t in rows])
        else:
            usable = F.col(vector).isNotNull() & F.col(label).isNotNull()
            fitted = train if max_train is None else head_by_hash(train.filter(usable), key, max_train, seed)
            data = _training_rows(fitted, key, vector, label, partitions).persist()
            n = data.count()
            if not n:
                raise ValueError("both sides need labelled rows")
            flats = [mlp.init_parameters(dim, int(t["num_hidden_layers"]), seed) for t in rows]
            states = [np.concatenate([f, np.zeros(2 * len(f))]) for f in flats]
            for epoch in range(epochs if rows else 0):
                states = _trial_epoch(data, rows, states, dim, epoch, epochs, -(-n // partitions), seed)
            heads = [(np.split(s, 3)[0], int(t["num_hidden_layers"])) for s, t in zip(states, rows)]
            values = _mean_losses(checked, len(rows), dim, lambda x, y: [(mlp.predict(w, x, k) - y) ** 2 for w, k in heads])
    finally:
        checked.unpersist()
        if data is not None:
            data.unpersist()
    done = [(*(t[c] for c in trials.columns), float(v)) for t, v in zip(rows, values)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trials.schema.fields)
    return spark.createDataFrame(done, f"{schema}, value double")
