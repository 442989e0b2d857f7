import math
import random

import pytest
from pyspark.sql import functions as F

from molspark.functions import metrics as M
from molspark.operators import reports as R
from molspark.operators.joins import join_one_to_one, score_registry


def pairs(spark, rows):
    return spark.createDataFrame(rows, "grp string, y double, y_pred double")


def expected(rows):
    rows = [(y, p) for _, y, p in rows if y is not None and p is not None]
    n = len(rows)
    res = sum((y - p) ** 2 for y, p in rows)
    mean = sum(y for y, _ in rows) / n
    tot = sum((y - mean) ** 2 for y, _ in rows)
    return n, sum(abs(y - p) for y, p in rows) / n, math.sqrt(res / n), (1 - res / tot if tot else None)


def test_report_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.gauss(1e4, 1), rng.gauss(1e4, 1)) for _ in range(500)]
    rows += [("a", None, 1.0), ("b", 1.0, None)]
    got = R.regression_report(pairs(spark, rows)).first()
    n, mae, rmse, r2 = expected(rows)
    assert got.n == n
    assert (got.mae, got.rmse, got.r2) == pytest.approx((mae, rmse, r2), rel=1e-9)
    by = {r.grp: r for r in R.regression_report_by(pairs(spark, rows), "grp", total=True).collect()}
    assert set(by) == {"a", "b", "c", None}
    assert by[None].r2 == pytest.approx(r2, rel=1e-9)
    for g in "abc":
        assert by[g].mae == pytest.approx(expected([r for r in rows if r[0] == g])[1])


def test_total_is_told_from_a_null_group(spark):
    rows = [("a", 1.0, 2.0), (None, 3.0, 3.0), (None, 5.0, 5.0)]
    found = {(r.grp, r.level): r.n for r in R.regression_report_by(pairs(spark, rows), "grp", total=True).collect()}
    assert found == {("a", 0): 1, (None, 0): 2, (None, 1): 3}


def test_r2_is_not_the_squared_correlation(spark):
    row = pairs(spark, [("a", float(i), 10.0 * i) for i in range(5)]).agg(
        M.r2(F.col("y"), F.col("y_pred")).alias("r2"), F.regr_r2("y", "y_pred").alias("corr")
    ).first()
    assert row.corr == pytest.approx(1.0)
    assert row.r2 < -100


@pytest.mark.parametrize("rows", [[], [("a", 3.0, 1.0)], [("a", 3.0, 1.0), ("a", 3.0, 2.0)]])
def test_r2_is_null_without_spread(spark, rows):
    row = R.regression_report(pairs(spark, rows)).first()
    assert row.r2 is None
    assert row.n == len(rows)


def test_masked_loss(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 5.0), (0.0, 3.0)], "label double, p double")
    row = R.masked_loss(df, "label", "p").first()
    assert (row.n_rows, row.n_labelled, row.mse) == (3, 2, 5.0)
    assert R.masked_loss(df.filter("label IS NULL"), "label", "p").first().mse is None


def test_parity_histogram_counts_everything(spark):
    rng = random.Random(2)
    rows = [("a", rng.random(), rng.random()) for _ in range(300)] + [("a", None, 1.0)]
    bins = R.parity_histogram(pairs(spark, rows), 10).collect()
    assert sum(r.n for r in bins) == 300
    assert all(0 <= r.actual_bin < 10 and 0 <= r.predicted_bin < 10 for r in bins)


def test_parity_histogram_of_a_constant(spark):
    bins = R.parity_histogram(pairs(spark, [("a", 2.0, 2.0)] * 3), 10).collect()
    assert [(r.actual_bin, r.predicted_bin, r.n) for r in bins] == [(0, 0, 3)]
    assert R.parity_histogram(pairs(spark, []), 10).count() == 0


def test_epoch_losses_skip_missing_errors(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 1, 4.0), (1, 2, None)], "run int, epoch int, e double")
    found = {(r.run, r.epoch): (r.eval_loss, r.n) for r in R.epoch_losses(df, "run", "epoch", "e").collect()}
    assert found == {(1, 1): (3.0, 2), (1, 2): (None, 0)}


def test_rename_and_select_raise_on_missing(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, lumo double")
    assert R.rename_column(df, "lumo", "labels").columns == ["id", "labels"]
    with pytest.raises(ValueError):
        R.rename_column(df, "homo", "labels")
    with pytest.raises(ValueError):
        R.rename_column(df, "lumo", "id")
    with pytest.raises(ValueError):
        R.select_columns(df, ["id", "labels"])


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "x int, s string")
    rows = {r.column: r for r in R.dataset_profile(df, exact=True).collect()}
    assert (rows["x"].n_rows, rows["x"].n_null, rows["x"].n_distinct) == (3, 0, 2)
    assert (rows["x"].min_value, rows["x"].max_value, rows["x"].type) == (1.0, 2.0, "int")
    assert (rows["s"].n_null, rows["s"].n_distinct, rows["s"].min_value) == (1, 2, None)
    assert {r.n_rows for r in R.dataset_profile(df.limit(0)).collect()} == {0}


def test_preview_takes_the_first_by_key(spark):
    assert [r.id for r in R.preview(spark.range(100).orderBy(F.col("id").desc()), "id", 3).collect()] == [0, 1, 2]


def test_one_to_one_join(spark):
    left = spark.createDataFrame([(1, 0.5), (2, 0.7)], "id int, p double")
    right = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "id int, s string")
    inner = join_one_to_one(left, right, "id", "inner")
    assert {(r.id, r.p, r.s) for r in inner.collect()} == {(1, 0.5, "a"), (2, 0.7, "b")}
    with pytest.raises(Exception, match="one side only: 3"):
        join_one_to_one(left, right, "id").collect()
    matched = join_one_to_one(left, right.filter("id < 3"), "id")
    assert {(r.id, r.p, r.s) for r in matched.collect()} == {(1, 0.5, "a"), (2, 0.7, "b")}
    with pytest.raises(Exception, match="more than once on the left"):
        join_one_to_one(left.union(left), right, "id").collect()
    with pytest.raises(Exception, match="more than once on the right"):
        join_one_to_one(left, right.union(right), "id").count()


def test_registry_gives_every_pair(spark):
    registry = [{"property": "a", "k": 1.0}, {"property": "b", "k": 2.0}]
    df = score_registry(spark.range(5), registry, F.col("id") * F.col("model.k"))
    assert sorted((r.id, r.model.ord, r.value) for r in df.collect()) == [
        (i, o, i * k) for i in range(5) for o, k in ((0, 1.0), (1, 2.0))
    ]
