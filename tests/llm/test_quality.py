"""Statistics, kernel, sums and calibration against plain counterparts; held-out accuracy of the query."""

import numpy as np
import pytest
from helpers import no_docs, odd_docs
from pyspark.sql import functions as F

from molspark.llm import quality, queries
from molspark.session import materialize

TENTH = "/root/testdata/sf0.1"


def named(text):
    return dict(zip(quality.STATISTICS, quality.statistics(text.encode()), strict=True))


def test_statistics_of_a_text():
    got = named("Ab cd cd.\n12 x!\n\nAb cd cd.")
    assert got["upper"] == pytest.approx(2 / 26) and got["newline"] == pytest.approx(3 / 26) and got["stop"] == pytest.approx(3 / 26)
    assert got["words"] == pytest.approx(np.log(9)) and got["distinct_words"] == 5 / 8 and got["top_word"] == 2 / 8
    assert got["echoes"] == 0 and got["distinct_pairs"] == 5 / 7
    assert named("cd cd a cd cd cd")["echoes"] == 3 / 6
    assert got["lettered_words"] == 7 / 8 and got["distinct_lines"] == 2 / 3 and got["lines"] == pytest.approx(np.log(4))
    assert set(named("").values()) == {0.0}
    assert sum(named("aé1 \n.,#\x01").get(kind) for kind in quality._KINDS) == pytest.approx(1)
    assert named("日本語")["lettered_words"] == 1


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(40, 24))
    z = quality.fourier(rows, np.zeros(24), np.ones(24), 8192)
    exact = np.exp(-((rows[:, None] - rows[None]) ** 2).sum(-1) / (2 * 24)) + 1
    assert np.abs(z @ z.T - exact).max() < 0.06


def labelled(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    causes = rng.normal(size=(n, 3))  # statistics of documents go together: few causes, many numbers
    stats = causes @ np.random.default_rng(0).normal(size=(3, len(quality.STATISTICS)))
    target = (np.abs(causes[:, 0]) + 0.1 * rng.normal(size=n) > 0.67).astype(float)
    data = [(int(i), [float(x) for x in stats[i]], float(target[i]), "clash") for i in range(n)]
    return spark.createDataFrame(data, "id long, stats array<double>, target double, fold string"), stats, target


def test_sums_equal_one_product(spark):
    df, stats, target = labelled(spark)
    mean, scale = stats.mean(axis=0), stats.std(axis=0)
    rows = df.select((F.col("id") % 4).cast("int").alias("fold"), "stats", "target").repartition(7)
    got = quality.normal_equations(rows, mean, scale, features=150)
    z = np.column_stack([quality.fourier(stats, mean, scale, 150), target])
    for k in range(4):
        own = z[np.arange(len(z)) % 4 == k]
        assert np.allclose(got[k], own.T @ own)


def test_ridge_equals_direct_fits(spark):
    df, stats, target = labelled(spark, 400)
    z = quality.fourier(stats, stats.mean(axis=0), stats.std(axis=0), 60)
    folds = np.arange(400) % 4
    whole = np.column_stack([z, target])
    weights = quality.ridge_weights(np.array([whole[folds == k].T @ whole[folds == k] for k in range(4)]))
    errors = {}
    for ridge in quality.RIDGES:
        fits = []
        for k in [0, 1, 2, 3, None]:
            own, y = (z[folds != k], target[folds != k]) if k is not None else (z, target)
            fits.append(np.linalg.solve(own.T @ own + np.diag([len(own) * ridge] * 60 + [1e-9]), own.T @ y))
        errors[ridge] = sum(((target[folds == k] - z[folds == k] @ fits[k]) ** 2).sum() for k in range(4)), fits
    assert np.allclose(weights, np.column_stack(min(errors.values(), key=lambda x: x[0])[1]), atol=1e-6)


def test_isotonic_equals_the_min_max_formula():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = rng.integers(1, 25)
        y, w = rng.random(n).round(1), rng.integers(1, 5, n).astype(float)
        mean = lambda a, b: (y[a : b + 1] @ w[a : b + 1]) / w[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        knots, levels = quality.isotonic(np.arange(n, dtype=float), y, w)
        assert np.allclose(sorted(set(np.round(want, 9))), np.unique(np.round(levels, 9)))
        assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()


def test_learns_a_rule_that_no_line_separates_and_calibrates_it(spark):
    df, _, _ = labelled(spark, 4000)
    model = quality.fit(df)
    fresh, _, target = labelled(spark, 2000, seed=2)
    got = quality.score(fresh.select("id", "stats"), model).orderBy("id").toPandas().score.to_numpy()
    assert ((got > 0.5) == target).mean() > 0.8
    for low in (0.0, 0.25, 0.5, 0.75):
        inside = (got >= low) & (got < low + 0.25)
        assert abs(got[inside].mean() - target[inside].mean()) < 0.02 + 3 * 0.5 / np.sqrt(inside.sum())


def test_odd_documents_and_labels(spark):
    docs = odd_docs(spark)
    stats = materialize(quality.with_statistics(docs), "statistics")
    assert stats.columns == [name for name in docs.columns if name != "text"] + ["stats"] and stats.count() == docs.count()
    marks = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (4, 1), (5, 7), (None, 1)], "doc_id long, target int")
    model = quality.fit(stats.select("doc_id", "stats").join(marks, "doc_id").withColumnRenamed("doc_id", "id"), features=16)
    told = quality.score(stats, model).collect()
    assert len(told) == docs.count() and all(0 <= row.score <= 1 for row in told)
    assert len({row.score for row in told if row.doc_id in (1, 2)}) == 1  # one text, one score


def test_nothing_learned(spark):
    stats = quality.with_statistics(odd_docs(spark))
    model = quality.fit(stats.select(F.col("doc_id").alias("id"), "stats", F.lit(None).cast("int").alias("target")))
    assert {row.score for row in quality.score(stats, model).collect()} == {0.5}
    assert quality.score(quality.with_statistics(no_docs(spark)), model).count() == 0
    one = quality.fit(stats.select(F.col("doc_id").alias("id"), "stats", F.lit(1).alias("target")), features=16)
    assert {round(row.score, 9) for row in quality.score(stats, one).collect()} == {1.0}


def test_query_on_documents_held_out(spark):
    told = queries.all_queries()["op12_quality"](spark, TENTH)
    marks = spark.read.parquet(f"{TENTH}/labels.parquet").where("quality is not null")
    assert told.count() == spark.read.parquet(f"{TENTH}/documents.parquet").count()
    held = told.where("held_out").join(marks, "doc_id")
    right, n, brier = held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*"), F.avg((F.col("score") - F.col("quality")) ** 2)).first()
    assert n > 900 and right > 0.98 and brier < 0.02
