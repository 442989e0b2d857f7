"""The next trials of a search, where good trials are dense and the others are not.

Each parameter's range is cut into bins. Of a study's completed trials the best share is good; a
bin's density is the sum of a triangular kernel over the trials near it, plus one. Candidates are
drawn from the density of the good trials, parameter by parameter, and ranked by the product of
the ratios of both densities. All of it is counting: after the trials are ranked once, tables
have a bounded number of rows for each study.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molspark.functions.hashing import seeded_uniform
from molspark.operators import search
from molspark.operators.ranking import sorted_rank
from molspark.session import materialize

#: Bins of a continuous parameter, and how many bins away its kernel ends.
BINS, REACH = 32, 4
#: Digits of a score that decide; equal scores go to the earlier candidate.
SCORE_DIGITS = 9


@dataclass(frozen=True)
class Dimension:
    """A parameter between ``low`` and ``high``, evenly in its logarithm with ``log``; whole numbers
    with ``whole``; or one of ``options``."""

    name: str
    low: float = 0.0
    high: float = 1.0
    log: bool = False
    whole: bool = False
    options: tuple = ()

    @property
    def bins(self) -> int:
        return len(self.options) or (int(self.high - self.low) + 1 if self.whole else BINS)

    @property
    def reach(self) -> int:
        return 1 if self.options or self.whole else REACH

    def bin(self) -> Column:
        """The bin of a value, the nearest for a number out of range; null for null, NaN and other options."""
        value = F.col(self.name)
        if self.options:
            return F.nullif(F.array_position(F.array(*map(F.lit, self.options)), value), F.lit(0)).cast("int") - 1
        if self.whole:
            at = value - F.lit(self.low)
        elif self.log:
            at = (F.log(value) - F.lit(math.log(self.low))) / F.lit(math.log(self.high) - math.log(self.low)) * F.lit(self.bins)
        else:
            at = (value - F.lit(self.low)) / F.lit(self.high - self.low) * F.lit(self.bins)
        at = at.cast("double")
        return F.when(at.isNotNull() & ~F.isnan(at), F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(self.bins - 1))).cast("int")

    def value(self, at: Column, within: Column) -> Column:
        """The value of bin ``at`` at the share ``within`` of its width."""
        if self.options:
            return F.element_at(F.array(*map(F.lit, self.options)), at + 1)
        if self.whole:
            return (at + F.lit(int(self.low))).cast("int")
        return search.uniform_float((at + within) / F.lit(self.bins), self.low, self.high, self.log)


#: The search space of the regression head.
SPACE = (
    Dimension("dropout", *search.DROPOUT),
    Dimension("num_hidden_layers", *search.NUM_HIDDEN_LAYERS, whole=True),
    Dimension("learning_rate", *search.LEARNING_RATE, log=True),
    Dimension("batch_size", options=search.BATCH_SIZES),
)


def _marked_good(trials: DataFrame, by: str, trial: str, value: str, share: float) -> DataFrame:
    """Completed trials with ``good``: the ``ceil(share * n)`` best of the study, ties to the lower trial.
    Ranks come from one range-partitioned pass, so a study may hold any share of the rows."""
    number = F.col(value).cast("double")
    done = trials.where(number.isNotNull() & ~F.isnan(number))
    ranked = sorted_rank(done, [F.col(by), number, F.col(trial)], "_rank")
    sizes = ranked.groupBy(F.col(by).alias("_by")).agg((F.min("_rank") + F.ceil(F.lit(share) * F.count("*"))).alias("_end"))
    return ranked.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).withColumn("good", F.col("_rank") < F.col("_end"))


def densities(
    trials: DataFrame, by: str = "study", trial: str = "trial_id", value: str = "value", space: Sequence[Dimension] = SPACE, share: float = 0.25
) -> DataFrame:
    """(by, dimension, bin, good, other): kernel sums over the good and the other completed trials of a
    study, plus one. Every bin of every study is there, also of studies without completed trials."""
    marked = _marked_good(trials.select(by, trial, value, *[d.name for d in space]), by, trial, value, share)
    bins = F.array(*[F.struct(F.lit(d.name).alias("dimension"), F.lit(d.bins).alias("bins"), F.lit(d.reach).alias("reach"), d.bin().alias("bin")) for d in space])
    counted = marked.select(F.col(by).alias("_by"), "good", F.explode(bins).alias("d")).where("d.bin is not null")
    counted = counted.groupBy("_by", "d").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("other"))
    near = F.sequence(F.greatest(F.col("d.bin") - F.col("d.reach") + 1, F.lit(0)), F.least(F.col("d.bin") + F.col("d.reach"), F.col("d.bins")) - 1)
    spread = counted.select("_by", "d", "good", "other", F.explode(near).alias("bin"))
    weight = F.col("d.reach") - F.abs(F.col("bin") - F.col("d.bin"))
    spread = spread.select("_by", "d.dimension", "bin", (weight * F.col("good")).alias("good"), (weight * F.col("other")).alias("other"))
    every = F.array(*[F.struct(F.lit(d.name).alias("dimension"), F.sequence(F.lit(0), F.lit(d.bins - 1)).alias("all")) for d in space])
    studies = trials.select(F.col(by).alias("_by")).distinct().select("_by", F.explode(every).alias("d"))
    flat = studies.select("_by", "d.dimension", F.explode("d.all").alias("bin"), F.lit(1).cast("long").alias("good"), F.lit(1).cast("long").alias("other"))
    summed = spread.unionByName(flat).groupBy("_by", "dimension", "bin").agg(F.sum("good").alias("good"), F.sum("other").alias("other"))
    return summed.withColumnRenamed("_by", by)


def _table(dimension: Dimension) -> Column:
    """The bins of one parameter of a study, in order."""
    own = F.when(F.col("dimension") == dimension.name, F.struct("bin", "cum", "score"))
    return F.sort_array(F.collect_list(own)).alias(f"_table_{dimension.name}")


def _drawn_bin(table: Column, u: Column) -> Column:
    aim = u * F.element_at(table, -1)["cum"]
    return F.size(F.filter(table, lambda x: x["cum"] <= aim))


def propose(
    trials: DataFrame, by: str = "study", trial: str = "trial_id", value: str = "value", space: Sequence[Dimension] = SPACE,
    share: float = 0.25, n_next: int = 1, n_candidates: int = 24, seed: int = 42,
) -> DataFrame:
    """(by, trial, parameters, score): the ``n_next`` next trials of each study, numbered after its last.

    Of ``n_candidates`` draws for each study those with the greatest sum of log density ratios are
    taken, ties to the earlier draw. Draws depend on the seed, the study and its last trial, so a round
    can be repeated. Trials whose value is null or NaN count as not completed; a null parameter is left
    out of its own density. Trials that repeat an id count each. A null study is a study. An empty
    table gives an empty one.
    """
    if not 0 < share < 1 or n_candidates < n_next:
        raise ValueError("the share must be between 0 and 1, and the candidates at least as many as the trials wanted")
    told = materialize(densities(trials, by, trial, value, space, share), "densities")
    up_to = Window.partitionBy(by, "dimension").orderBy("bin")  # a fixed number of bins
    steps = told.withColumn("cum", F.sum("good").over(up_to)).withColumn("score", F.log("good") - F.log("other"))
    tables = steps.groupBy(F.col(by).alias("_by")).agg(*[_table(d) for d in space])
    last = trials.groupBy(by).agg(F.max(trial).alias("_last"))
    drawn = last.join(tables, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))))

    def u(name: str) -> Column:
        return seeded_uniform([F.lit(name), F.col(by), F.col("_last"), F.col("_draw")], seed)

    for d in space:
        drawn = drawn.withColumn(f"_bin_{d.name}", _drawn_bin(F.col(f"_table_{d.name}"), u(d.name)))
    score = sum((F.element_at(f"_table_{d.name}", F.col(f"_bin_{d.name}") + 1)["score"] for d in space), F.lit(0.0))
    scored = drawn.select(
        by, "_last", "_draw", F.round(score, SCORE_DIGITS).alias("score"), *[d.value(F.col(f"_bin_{d.name}"), u(f"{d.name} within")).alias(d.name) for d in space]
    )
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), "_draw"))
    chosen = scored.withColumn("_place", place).where(F.col("_place") <= n_next)
    return chosen.select(by, (F.coalesce("_last", F.lit(-1)) + F.col("_place")).alias(trial), *[d.name for d in space], "score")


def append_round(trials: DataFrame, proposed: DataFrame) -> DataFrame:
    """``trials`` with the proposed ones, whose value is still null."""
    return trials.unionByName(proposed.select([c for c in proposed.columns if c in trials.columns]), allowMissingColumns=True)
