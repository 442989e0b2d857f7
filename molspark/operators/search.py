"""Hyper-parameter search tables: draws, leaderboards, history and retention."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molspark.session import materialize

from molspark.functions.hashing import as_columns, seeded_uniform

# The search space of the regression head.
DROPOUT = (0.0, 0.5)
NUM_HIDDEN_LAYERS = (1, 3)
LEARNING_RATE = (1e-6, 1e-3)
BATCH_SIZES = (16, 32, 64)

PARAMETERS = ("dropout", "num_hidden_layers", "learning_rate", "batch_size")



def uniform_float(u: Column, low: float, high: float, log: bool = False) -> Column:
    if log:
        return F.exp(F.lit(math.log(low)) + u * F.lit(math.log(high) - math.log(low)))
    return F.lit(low) + u * F.lit(high - low)


def uniform_int(u: Column, low: int, high: int) -> Column:
    """Integer between ``low`` and ``high``, both included."""
    return (F.lit(low) + F.floor(u * F.lit(high - low + 1))).cast("int")


def choice(u: Column, options) -> Column:
    position = F.floor(u * F.lit(len(options))).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in options]), position + 1)


def draw_parameters(df: DataFrame, trial: str | list[str], seed: int = 42) -> DataFrame:
    """Add one draw from the search space to every row, reproducible by (seed, trial)."""
    keys = as_columns(trial)

    def u(parameter: str) -> Column:
        return seeded_uniform([F.lit(parameter), *keys], seed)

    return df.withColumns(
        {
            "dropout": uniform_float(u("dropout"), *DROPOUT),
            "num_hidden_layers": uniform_int(u("num_hidden_layers"), *NUM_HIDDEN_LAYERS),
            "learning_rate": uniform_float(u("learning_rate"), *LEARNING_RATE, log=True),
            "batch_size": choice(u("batch_size"), BATCH_SIZES),
        }
    )


def random_trials(spark: SparkSession, n_trials: int = 20, seed: int = 42) -> DataFrame:
    trials = spark.range(n_trials).select(F.col("id").cast("int").alias("trial_id"))
    return draw_parameters(trials, "trial_id", seed)


def _completed(df: DataFrame, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def best_trial(df: DataFrame, by: str | None = None, trial: str = "trial_id", value: str = "value") -> DataFrame:
    """The row with the smallest value, per study if ``by`` is given; ties go to the lowest trial."""
    rest = [c for c in df.columns if c != by]
    row = F.min_by(F.struct(*rest), F.struct(F.col(value), F.col(trial))).alias("_best")
    done = _completed(df, value)
    picked = done.groupBy(by).agg(row) if by else done.agg(row).filter("_best IS NOT NULL")
    return picked.select(*([by] if by else []), "_best.*")


def leaderboard(
    df: DataFrame, k: int = 10, by: str | None = None, trial: str = "trial_id", value: str = "value"
) -> DataFrame:
    """The ``k`` best trials with their place, overall or per study.

    Both forms keep only ``k`` candidates per task (and study) before the shuffle.
    """
    done = _completed(df, value)
    if by is None:
        done = done.orderBy(value, trial).limit(k)
        place = F.row_number().over(Window.orderBy(value, trial))
        return done.withColumn("place", place)
    place = F.row_number().over(Window.partitionBy(by).orderBy(value, trial))
    return done.withColumn("place", place).filter(F.col("place") <= k)


def best_so_far(
    df: DataFrame, by: str = "study", trial: str = "trial_id", value: str = "value", partitions: int | None = None
) -> DataFrame:
    """Add the running minimum over the trials of a study, and its log10 where positive.

    A study may hold any share of the table and its ids may be spread in any way: rows are range
    partitioned by study and trial, so every task gets an equal share of the rows in order. Each
    (study, partition) is reduced to its minimum, and a row combines the minimum of the earlier
    partitions with the running minimum within its own. Rows without an id come first. Rows are
    written once, so that both steps see the same layout after a lost executor.
    """
    number = F.col(value).cast("double")
    order = [F.col(by), F.col(trial)]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = materialize(ranged.withColumn("_part", F.spark_partition_id()), "best_so_far")
    usable = F.when(~F.isnan(number), number)
    parts = placed.groupBy(F.col(by).alias("_study"), F.col("_part").alias("_of")).agg(F.min(usable).alias("_min"))
    before = Window.partitionBy("_study").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    # One row per study and partition of the range.
    earlier = parts.withColumn("_earlier", F.min("_min").over(before)).drop("_min")
    within = Window.partitionBy(by, "_part").orderBy(trial).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = placed.withColumn("_own", F.min(usable).over(within))
    joined = own.join(earlier, F.col(by).eqNullSafe(F.col("_study")) & (F.col("_part") == F.col("_of")))
    best = F.least("_earlier", "_own")
    return (
        joined.withColumn("best_value", best)
        .withColumn("log10_best", F.when(F.col("best_value") > 0, F.log10("best_value")))
        .drop("_part", "_study", "_of", "_earlier", "_own")
    )


def checkpoint_retention(
    df: DataFrame, run: str = "run", epoch: str = "epoch", loss: str = "eval_loss", keep: int = 2
) -> DataFrame:
    """The checkpoints left when ``keep`` are kept per run: the best, then the latest.

    The best has the smallest loss and, on a tie, the earliest epoch. Each branch keeps at
    most ``keep`` rows per run and task before its shuffle.
    """
    log = df.select(run, epoch, loss)
    best = (
        _completed(log, loss)
        .groupBy(run)
        .agg(F.min(F.struct(F.col(loss), F.col(epoch))).alias("_b"))
        .select(run, F.col(f"_b.{epoch}").alias(epoch), F.col(f"_b.{loss}").alias(loss), F.lit(1).alias("_best"))
    )
    recent = F.row_number().over(Window.partitionBy(run).orderBy(F.col(epoch).desc()))
    latest = (
        log.withColumn("_recent", recent).filter(F.col("_recent") <= keep).drop("_recent").withColumn("_best", F.lit(0))
    )
    candidates = best.unionByName(latest).groupBy(run, epoch, loss).agg(F.max("_best").alias("_best"))
    place = F.row_number().over(Window.partitionBy(run).orderBy(F.col("_best").desc(), F.col(epoch).desc()))
    return (
        candidates.withColumn("_place", place)
        .filter(F.col("_place") <= keep)
        .select(run, epoch, loss, (F.col("_best") == 1).alias("is_best"))
    )


def trials_tall(df: DataFrame, key: str, dimensions: list[str]) -> DataFrame:
    """(key, dimension, value, scaled): one row per trial and dimension, scaled to [0, 1].

    The ranges come from one aggregate row, read as a scalar subquery. A constant
    dimension scales to null.
    """
    wide = df.select(key, *[F.col(d).cast("double").alias(d) for d in dimensions])
    ranges = wide.agg(
        F.struct(*[F.struct(F.min(d).alias("low"), F.max(d).alias("high")).alias(d) for d in dimensions]).alias("r")
    )
    scaled = wide.withColumn("_r", ranges.scalar())
    entries = [
        F.struct(
            F.lit(d).alias("dimension"),
            F.col(d).alias("value"),
            (
                (F.col(d) - F.col(f"_r.{d}.low"))
                / F.nullif(F.col(f"_r.{d}.high") - F.col(f"_r.{d}.low"), F.lit(0.0))
            ).alias("scaled"),
        )
        for d in dimensions
    ]
    return scaled.select(key, F.explode(F.array(*entries)).alias("_e")).select(key, "_e.*")
