import math
import random

import pytest
from pyspark.sql import functions as F

from molspark.operators import search as S
from molspark.operators import trends as T


def values(spark, rows):
    return spark.createDataFrame(rows, "mol_id int, family string, carbons int, property string, value double")


def test_trend_check(spark):
    rows = [(i, "alkene", c, "p", v) for i, (c, v) in enumerate([(2, 1.0), (4, 3.0), (4, 5.0), (6, 4.0), (8, 9.0)])]
    rows += [(9, "alcohol", c, "p", float(c)) for c in (2, 4)] + [(10, "single", 3, "p", 1.0)]
    rows += [(11, "alkene", 7, "p", None)]
    found = {r.family: r for r in T.trend_check(T.trend_table(values(spark, rows))).collect()}
    # Means are 1, 4, 4, 9: one step does not rise.
    assert (found["alkene"].n_points, found["alkene"].violations, found["alkene"].monotone) == (4, 1, False)
    assert found["alcohol"].monotone and found["alcohol"].slope == pytest.approx(1.0)
    assert found["single"].violations == 0 and found["single"].slope is None


def test_family_compare(spark):
    rows = [(1, "alkene", 2, "p", 1.0), (2, "alkene", 2, "p", 3.0), (3, "alcohol", 2, "p", 5.0),
            (4, "alcohol", 4, "p", 1.0), (5, "alkene", 6, "p", 2.0), (6, "alcohol", 6, "p", 2.0)]
    found = {r.carbons: r for r in T.family_compare(values(spark, rows)).collect()}
    assert set(found) == {2, 6}
    assert (found[2].alkene_value, found[2].alcohol_value, found[2].delta, found[2].holds) == (2.0, 5.0, 3.0, True)
    assert not found[6].holds


def test_property_order(spark):
    m, f, b = T.TEMPERATURES
    rows = [(1, "x", 2, m, 1.0), (1, "x", 2, f, 2.0), (1, "x", 2, b, 3.0),
            (2, "x", 2, m, 5.0), (2, "x", 2, f, 2.0), (2, "x", 2, b, 3.0),
            (3, "x", 2, m, 1.0), (3, "x", 2, b, 3.0)]
    found = {r.mol_id: r.ordered for r in T.property_order(values(spark, rows), "mol_id").collect()}
    assert found == {1: True, 2: False, 3: None}


def test_unwrap_needs_exactly_one_property(spark):
    one = spark.range(2).select("id", F.create_map(F.lit("bp"), F.struct(F.lit(1.5).alias("value"))).alias("pred"))
    assert [(r.id, r.property, r.value) for r in T.unwrap_prediction(one, "pred").collect()] == [
        (0, "bp", 1.5), (1, "bp", 1.5)]
    two = one.withColumn("pred", F.map_concat("pred", F.create_map(F.lit("mp"), F.struct(F.lit(2.5).alias("value")))))
    with pytest.raises(Exception, match="exactly one"):
        T.unwrap_prediction(two, "pred").collect()


def test_search_space_bounds_and_seed(spark):
    rows = S.random_trials(spark, 400).collect()
    assert all(0 <= r.dropout < 0.5 and 1e-6 <= r.learning_rate < 1e-3 for r in rows)
    assert {r.num_hidden_layers for r in rows} == {1, 2, 3}
    assert {r.batch_size for r in rows} == {16, 32, 64}
    low = sum(r.learning_rate < math.sqrt(1e-6 * 1e-3) for r in rows)
    assert 150 < low < 250
    assert rows == S.random_trials(spark, 400).collect()
    assert rows[:5] == S.random_trials(spark, 5).orderBy("trial_id").collect()
    assert rows[0] != S.random_trials(spark, 1, seed=7).first()


def trial_rows(spark, rows):
    return spark.createDataFrame(rows, "study int, trial_id int, value double")


def test_best_trial_breaks_ties_and_skips_failures(spark):
    rows = [(1, 3, 0.5), (1, 2, 0.5), (1, 9, 0.7), (2, 1, None), (2, 4, float("nan")), (2, 5, 8.0), (3, 1, None)]
    found = {r.study: r.trial_id for r in S.best_trial(trial_rows(spark, rows), "study").collect()}
    assert found == {1: 2, 2: 5}
    assert S.best_trial(trial_rows(spark, rows)).first().trial_id == 2
    assert S.best_trial(trial_rows(spark, [])).count() == 0


def test_leaderboard(spark):
    rows = [(i % 2, i, float((i * 7) % 5)) for i in range(20)]
    top = S.leaderboard(trial_rows(spark, rows), 4).orderBy("place").collect()
    assert [(r.value, r.trial_id) for r in top] == sorted((v, t) for _, t, v in rows)[:4]
    by = S.leaderboard(trial_rows(spark, rows), 3, by="study").collect()
    for study in (0, 1):
        mine = sorted((v, t) for s, t, v in rows if s == study)[:3]
        assert [(r.value, r.trial_id) for r in sorted(by, key=lambda r: r.place) if r.study == study] == mine


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_best_so_far_against_brute_force(spark, partitions):
    rng = random.Random(4)
    # Study 1 holds most of the rows.
    rows = [(1 if rng.random() < 0.7 else rng.randint(2, 5), i, float(rng.randint(-5, 500))) for i in range(400)]
    rows += [(9, 1000, None), (9, 1001, 3.0), (9, 1002, float("nan")), (None, 2000, 1.0)]
    found = {(r.study, r.trial_id): (r.best_value, r.log10_best)
             for r in S.best_so_far(trial_rows(spark, rows), partitions=partitions).collect()}
    assert len(found) == len(rows)
    best = {}
    for study, trial, value in sorted(rows, key=lambda r: r[1]):
        if value is not None and not math.isnan(value):
            best[study] = min(best.get(study, math.inf), value)
        expect = best.get(study)
        got, log = found[study, trial]
        assert got == expect
        assert log == (pytest.approx(math.log10(expect)) if expect and expect > 0 else None)


def test_best_so_far_with_an_outlier_id_and_null_ids(spark):
    ids = spark.range(3000).select(F.lit(1).alias("study"), F.col("id").alias("trial_id"), (3000.0 - F.col("id")).alias("value"))
    odd = spark.createDataFrame([(1, 10**15, 7.0), (1, None, 2500.0)], "study int, trial_id long, value double")
    done = S.best_so_far(ids.unionByName(odd), partitions=16).cache()
    assert done.count() == 3002
    found = {r.trial_id: r.best_value for r in done.collect()}
    assert found[None] == 2500.0 and found[0] == 2500.0 and found[2999] == 1.0 and found[10**15] == 1.0
    # the rows a task orders: an equal share, however the ids are spread
    ranged = ids.unionByName(odd).repartitionByRange(16, "study", "trial_id")
    assert ranged.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 600


def simulate_retention(losses, keep=2):
    """Keep as a trainer does after every epoch: the best so far, then the newest."""
    kept, best = [], None
    for epoch, loss in losses:
        kept.append(epoch)
        if best is None or loss < dict(losses)[best]:
            best = epoch
        while len(kept) > keep:
            kept.remove(min(e for e in kept if e != best))
    return set(kept), best


def test_retention_equals_epoch_by_epoch_simulation(spark):
    rng = random.Random(6)
    logs = {run: [(e, float(rng.randint(0, 6))) for e in range(1, rng.randint(2, 12))] for run in range(40)}
    rows = [(run, e, loss) for run, log in logs.items() for e, loss in log]
    df = spark.createDataFrame(rows, "run int, epoch int, eval_loss double")
    found = {}
    for r in S.checkpoint_retention(df).collect():
        found.setdefault(r.run, {})[r.epoch] = r.is_best
    for run, log in logs.items():
        kept, best = simulate_retention(log)
        assert set(found[run]) == kept
        assert [e for e, flag in found[run].items() if flag] == [best]


def test_trials_tall(spark):
    df = spark.createDataFrame([(1, 0.0, 16), (2, 0.5, 16), (3, 0.25, 16)], "t int, dropout double, batch int")
    found = {(r.t, r.dimension): (r.value, r.scaled) for r in S.trials_tall(df, "t", ["dropout", "batch"]).collect()}
    assert found[2, "dropout"] == (0.5, 1.0) and found[3, "dropout"] == (0.25, 0.5)
    assert found[1, "batch"] == (16.0, None)
    assert len(found) == 6
