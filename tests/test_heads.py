import dataclasses
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from molspark.functions import mlp
from molspark.operators import heads as H
from molspark.operators import search
from molspark.operators.heads import HeadParams
from molspark.plans.finetune import finetune_head, prepare_examples, tune_hyperparameters
from molspark.plans.inference import PROPERTIES, predict_and_analyse
from molspark.sources import artifacts

DIM = 6


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, DIM)).astype("f4")
    y = x.astype("f8") @ np.arange(1, DIM + 1) + 0.5
    rows = [(i, x[i].tolist(), float(y[i])) for i in range(len(y))]
    df = spark.createDataFrame(rows, "id int, x array<float>, y double")
    return df, x.astype("f8"), y


@pytest.mark.parametrize("layers", [0, 1, 3])
def test_gradient_matches_finite_differences(layers):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(7, 4)), rng.normal(size=7)
    flat = mlp.init_parameters(4, layers, 3)
    assert len(flat) == mlp.n_parameters(4, layers)
    loss, grad = mlp.squared_error_gradient(flat, x, y, layers)
    assert loss == pytest.approx(((mlp.predict(flat, x, layers) - y) ** 2).sum())
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        up, down = (((mlp.predict(flat + s, x, layers) - y) ** 2).sum() for s in (step, -step))
        assert grad[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def test_gelu_is_exact():
    z = np.array([-2.0, 0.0, 1.5])
    assert mlp._gelu_parts(z)[0].tolist() == pytest.approx([v * 0.5 * (1 + math.erf(v / 2**0.5)) for v in z])


def test_erf_is_exact_to_rounding():
    z = np.concatenate([np.linspace(-7, 7, 100_001), [0.0, 1e-300, 40.0, -40.0]])
    assert np.abs(mlp.erf(z) - [math.erf(v) for v in z]).max() < 1e-12


def test_dropout_acts_on_full_gradients(data):
    df, _, _ = data
    params = HeadParams(num_hidden_layers=1, batch_size=None, epochs=2)
    a, b, c = (H.fit_head(df, "id", "x", "y", dataclasses.replace(params, dropout=p), partitions=3) for p in (0.0, 0.9, 0.9))
    assert not np.allclose(a.weights, b.weights)
    assert np.allclose(b.weights, c.weights, rtol=1e-9)


def test_gradient_does_not_depend_on_partitions(data):
    df, x, y = data
    flat = mlp.init_parameters(DIM, 2, 0)
    rows = df.select("x", "y")
    n, loss, grad = H.gradient_sums(rows.repartition(1), flat, DIM, 2)
    n8, loss8, grad8 = H.gradient_sums(rows.repartition(8), flat, DIM, 2)
    expect_loss, expect = mlp.squared_error_gradient(flat, x, y, 2)
    assert n == n8 == 400
    assert loss == pytest.approx(loss8, rel=1e-12) == pytest.approx(expect_loss, rel=1e-12)
    assert np.allclose(grad, grad8, rtol=1e-9) and np.allclose(grad, expect, rtol=1e-9)


def test_linear_head_recovers_a_planted_target(data):
    df, _, y = data
    head = H.fit_linear_head(df, "x", "y")
    assert np.allclose(head.weights, [*range(1, DIM + 1), 0.5], atol=1e-8)
    scored = df.select("id", "y", H.score("x", head).alias("p"))
    assert scored.agg(F.max(F.abs(F.col("p") - F.col("y")))).first()[0] < 1e-6


def test_fit_line(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("x"), (F.col("id") * 3.0 + 1).alias("y"))
    assert H.fit_line(df, "x", "y") == pytest.approx((3.0, 1.0))


@pytest.mark.parametrize("layers", [0, 1])
def test_mini_batch_training_lowers_the_loss(data, layers):
    df, _, y = data
    params = HeadParams(num_hidden_layers=layers, dropout=0.0, learning_rate=0.05, batch_size=8, epochs=8)
    head = H.fit_head(df, "id", "x", "y", params, partitions=3)
    assert len(head.history) == 8
    assert head.history[-1] < 0.2 * head.history[0] < 0.2 * (y**2).mean() * 2


def test_training_repeats_itself(data):
    df, _, _ = data
    params = HeadParams(num_hidden_layers=1, dropout=0.3, learning_rate=0.01, batch_size=16, epochs=2)
    a = H.fit_head(df, "id", "x", "y", params, partitions=3)
    b = H.fit_head(df.repartition(5), "id", "x", "y", params, partitions=3)
    assert np.allclose(a.weights, b.weights, rtol=1e-9)


def test_full_gradient_training_does_not_depend_on_partitions(data):
    df, _, _ = data
    params = HeadParams(num_hidden_layers=1, dropout=0.0, learning_rate=0.05, batch_size=None, epochs=4, warmup=0.0)
    a = H.fit_head(df, "id", "x", "y", params, partitions=1)
    b = H.fit_head(df, "id", "x", "y", params, partitions=7)
    assert np.allclose(a.weights, b.weights, rtol=1e-7)
    assert a.history[-1] < a.history[0]


def test_rows_without_label_or_vector_are_left_out(spark, data):
    df, _, _ = data
    extra = spark.createDataFrame([(1000, None, 1.0), (1001, [1.0] * DIM, None)], df.schema)
    params = HeadParams(num_hidden_layers=1, dropout=0.0, batch_size=None, epochs=1)
    a = H.fit_head(df, "id", "x", "y", params, partitions=2)
    b = H.fit_head(df.unionByName(extra), "id", "x", "y", params, partitions=2)
    assert a.history == pytest.approx(b.history)
    with pytest.raises(ValueError):
        H.fit_head(df.limit(0), "id", "x", "y", params)


def test_validation_keeps_the_best_epoch(data):
    df, x, y = data
    # A rate this high makes the loss jump about.
    params = HeadParams(num_hidden_layers=1, dropout=0.0, learning_rate=2.0, batch_size=16, epochs=6, warmup=0.0)
    head = H.fit_head(df.filter("id >= 100"), "id", "x", "y", params, val=df.filter("id < 100"), partitions=2)
    assert len(head.eval_history) == 6
    assert head.best_epoch == int(np.argmin(head.eval_history))
    loss = ((mlp.predict(head.weights, x[:100], 1) - y[:100]) ** 2).mean()
    assert loss == pytest.approx(min(head.eval_history))


def test_more_partitions_than_rows(spark, data):
    df, _, _ = data
    head = H.fit_head(df.filter("id < 2"), "id", "x", "y", HeadParams(epochs=1), partitions=8)
    assert np.isfinite(head.weights).all()


def test_score_handles_nulls_and_many_heads(spark, data):
    df, x, _ = data
    one, two = (H.Head(DIM, layers, mlp.init_parameters(DIM, layers, 9)) for layers in (2, 0))
    rows = df.unionByName(spark.createDataFrame([(-1, None, 0.0)], df.schema))
    found = {r.id: r.p for r in rows.select("id", H.score("x", one).alias("p")).collect()}
    assert found.pop(-1) is None
    assert [found[i] for i in range(400)] == pytest.approx(mlp.predict(one.weights, x, 2).tolist())
    both = H.score_properties(rows.select("id", "x"), "x", {"a": one, "b": two}).collect()
    assert len(both) == 2 * 401
    second = {r.id: r.value for r in both if r.property == "b" and r.id >= 0}
    assert [second[i] for i in range(400)] == pytest.approx(mlp.predict(two.weights, x, 0).tolist())
    linear = {r.id: r.p for r in rows.select("id", H.score("x", two).alias("p")).collect()}
    assert linear.pop(-1) is None
    assert linear == pytest.approx(second)


def test_user_hooks(spark):
    class Twice:
        def predict(self, rows: pd.DataFrame) -> pd.Series:
            return rows["a"] * 2 + rows["b"]

    df = spark.range(5).select("id", F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    got = H.score_with(df, Twice(), ["a", "b"]).orderBy("id").collect()
    assert [r.y_pred for r in got] == [1.0, 3.0, 5.0, 7.0, 9.0]
    mapped = H.map_rows(df.select("id"), lambda rows: rows.assign(twice=rows["id"] * 2), "id long, twice long")
    assert sorted(r.twice for r in mapped.collect()) == [0, 2, 4, 6, 8]


def test_map_predictor_takes_the_first_property(spark):
    class Model:
        def predict(self, smiles: list[str]) -> list[dict]:
            return [{"bp": {"value": float(len(s))}, "mp": {"value": -1.0}} if s else {} for s in smiles]

    df = spark.createDataFrame([(1, "CCO"), (2, ""), (3, "C")], "id int, smiles string")
    got = H.score_with(df, H.MapPredictor(Model()), ["smiles"]).orderBy("id").collect()
    assert [r.y_pred for r in got] == [3.0, None, 1.0]


def test_reloaded_head_scores_the_same(spark, data, scratch):
    df, x, _ = data
    head = H.Head(DIM, 1, mlp.init_parameters(DIM, 1, 2), (3.0, 2.0), (4.0, 5.0), 0)
    path = scratch("head")
    artifacts.save_head(spark, head, path, {"epochs": 2})
    loaded = artifacts.load_head(spark, path)
    assert (loaded.dim, loaded.num_hidden_layers, loaded.history) == (DIM, 1, (3.0, 2.0))
    assert (loaded.eval_history, loaded.best_epoch) == ((4.0, 5.0), 0)
    assert (loaded.weights == head.weights).all()
    assert artifacts.load_config(spark, path) == {"epochs": 2}


def test_sweep_depends_on_the_trial_only(spark, data):
    df, _, _ = data
    train, val = df.filter("id % 5 > 0"), df.filter("id % 5 = 0")
    trials = search.random_trials(spark, 4)

    def run(t):
        return {r.trial_id: r.value for r in H.sweep(t, train, val, "id", "x", "y").collect()}

    full = run(trials)
    assert set(full) == {0, 1, 2, 3} and all(math.isfinite(v) for v in full.values())
    assert run(trials.orderBy(F.col("trial_id").desc())) == pytest.approx(full)
    assert run(trials.filter("trial_id = 2"))[2] == pytest.approx(full[2])


def test_sweep_takes_every_row(spark):
    base = spark.range(6000).select("id", F.array(F.col("id") % 7 / 7.0, F.lit(1.0)).alias("x"), (F.col("id") % 7 / 7.0).alias("y"))
    odd = base.withColumn("y", F.when(F.col("id") == 5999, 1e4).otherwise(F.col("y")))
    trials = search.random_trials(spark, 2)
    values = [
        {r.trial_id: r.value for r in H.sweep(trials, train, val, "id", "x", "y", epochs=1).collect()}
        for train, val in ((base, base), (odd, base), (base, odd))
    ]
    assert all(values[0][t] != values[1][t] for t in values[0])
    assert all(values[2][t] > values[0][t] + 1000 for t in values[0])


def test_sweep_with_a_user_objective_sees_the_whole_side(spark, data):
    df, _, y = data
    trials = search.random_trials(spark, 3)
    wide = trials.withColumn("trial_id", F.col("trial_id").cast("bigint"))
    for t in (trials, wide):
        out = H.sweep(t, df, df, "id", "x", "y", lambda p, vx, vy: (vy - p["batch_size"]) ** 2).collect()
        assert len(out) == 3
        for r in out:
            assert r.value == pytest.approx(((y - r.batch_size) ** 2).mean())
    with pytest.raises(ValueError, match="unique"):
        H.sweep(trials.union(trials), df, df, "id", "x", "y")
    with pytest.raises(ValueError, match="more than"):
        H.sweep(trials, df, df, "id", "x", "y", max_trials=2)


def test_tuning_returns_the_best_trial(data):
    df, _, _ = data
    best, results = tune_hyperparameters(df.filter("id < 300"), df.filter("id >= 300"), "id", "x", "y", n_trials=3)
    rows = sorted(results.collect(), key=lambda r: (r.value, r.trial_id))
    assert len(rows) == 3
    assert best == {k: rows[0][k] for k in search.PARAMETERS}


def test_finetune_end_to_end(data):
    df, _, _ = data
    params = HeadParams(num_hidden_layers=1, dropout=0.0, learning_rate=0.05, batch_size=8, epochs=10)
    done = finetune_head(df, "id", "x", "y", params=params)
    report = done.report.first()
    assert report.n == 80
    assert report.r2 > 0.8
    tuned = finetune_head(df, "id", "x", "y", params=HeadParams(epochs=1), n_trials=2)
    assert tuned.report.first().n == 80


def test_prepare_examples(spark):
    df = spark.range(50).select(
        "id", F.concat(F.lit("CC"), F.repeat(F.lit("C"), (F.col("id") % 4).cast("int"))).alias("smiles"),
        F.col("id").cast("float").alias("lumo"),
    )
    examples, vocabulary = prepare_examples(df, "id", "lumo")
    rows = examples.collect()
    assert set(examples.columns) == {"id", "split", "labels", "input_ids", "attention_mask"}
    assert len(rows) == 50 and sum(r.split == "test" for r in rows) == 10
    assert [r.token for r in vocabulary.collect()] == ["C"]


def test_predict_and_analyse(spark, data):
    df, _, _ = data
    molecules = df.withColumn("family", F.when(F.col("id") % 2 == 0, "alkene").otherwise("alcohol")).withColumn(
        "carbons", F.col("id") % 10
    )
    heads = {p: H.Head(DIM, 0, np.array([0.0] * DIM + [float(-i)])) for i, p in enumerate(PROPERTIES)}
    found = predict_and_analyse(molecules, "id", "x", heads)
    assert found.values.count() == 1200
    assert all(r.ordered for r in found.ordered.collect())
    assert found.trend.count() == 3 * 10
