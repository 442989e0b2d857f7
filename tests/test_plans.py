"""The physical plans keep what the operators promise."""

import re

import pytest
from pyspark.sql import functions as F

from molspark.functions import smiles as S
from molspark.operators import heads, molecules, ranking, reports, search, splits, trends, vocab
from molspark.operators.joins import score_registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text: str) -> int:
    return len(re.findall(r"Exchange (?:hash|range|Single|RoundRobin)", text))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "t")
    spark.range(1000).select(
        "id",
        (F.col("id") % 7).alias("study"),
        F.col("id").cast("double").alias("value"),
        F.lit("CCO").alias("smiles"),
        F.array_repeat(F.lit(1.0).cast("float"), 4).alias("x"),
        F.lit("unused").alias("wide"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def read_columns(text: str) -> list[set]:
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*)>", text)]


def test_split_moves_no_rows(table):
    text = plan(splits.train_test_split(table, "id").select("id", "split"))
    assert shuffles(text) == 0
    assert read_columns(text) == [{"id"}]


def test_head_is_a_filter(table):
    text = plan(ranking.head_by_hash(table, "id", 10))
    assert shuffles(text) == 0 and "Filter" in text


def test_rank_broadcasts_only_cell_offsets(table):
    text = plan(ranking.hash_rank(table.select("id"), "id"))
    assert "BroadcastHashJoin" in text
    # The only single-task exchange carries one row per cell.
    single = text[text.index("Exchange SinglePartition"):]
    assert "HashAggregate" in single.split("\n")[1]
    assert len(re.findall("Exchange SinglePartition", text)) == 1


def test_validation_and_tokens_are_narrow_and_stay_in_the_jvm(table):
    text = plan(molecules.validate(table).select("id", "verdict", S.smiles_tokens(F.col("smiles"))))
    assert shuffles(text) == 0 and "Python" not in text
    assert read_columns(text) == [{"id", "smiles"}]


def test_registry_is_not_a_join(table):
    text = plan(score_registry(table.select("id"), [{"property": "a", "k": 1.0}, {"property": "b", "k": 2.0}]))
    assert "Join" not in text and "Cartesian" not in text and shuffles(text) == 0


def test_reports_shuffle_partial_aggregates_once(table):
    scored = table.select("study", F.col("value").alias("y"), (F.col("value") * 2).alias("y_pred"))
    text = plan(reports.regression_report_by(scored, "study", total=True))
    assert shuffles(text) == 1 and "partial_avg" in text
    assert read_columns(text) == [{"study", "value"}]


def test_top_k_is_limited_before_the_shuffle(table):
    trials = table.select("study", F.col("id").alias("trial_id"), "value")
    text = plan(search.leaderboard(trials, 3, by="study"))
    assert "Partial" in text and "WindowGroupLimit" in text
    assert "TakeOrderedAndProject" in plan(search.leaderboard(trials, 3))


def test_best_so_far_orders_within_range_partitions(table):
    trials = table.select("study", F.col("id").alias("trial_id"), "value")
    text = plan(search.best_so_far(trials))
    assert "SinglePartition" not in text
    windows = re.findall(r"Window \[min\((\w+)", text)
    assert len(windows) == 2
    assert re.search(r"Exchange hashpartitioning\(study#\d+L, _part#\d+", text)


def test_trend_checks_order_only_aggregates(table):
    values = table.select("value", F.lit("p").alias("property"), F.lit("f").alias("family"), F.col("id").alias("carbons"))
    text = plan(trends.trend_check(trends.trend_table(values)))
    window = text.index("Window [lag")
    assert "partial_avg" in text[window:]
    assert shuffles(plan(trends.property_order(values.withColumnRenamed("carbons", "mol_id"), "mol_id"))) == 1


def test_scoring_sends_only_the_vector_to_python(table):
    import numpy as np

    from molspark.functions import mlp

    head = heads.Head(4, 1, mlp.init_parameters(4, 1, 0))
    text = plan(table.withColumn("y", heads.score("x", head)).select("id", "y"))
    assert re.search(r"ArrowEvalPython \[run\(x#\d+\)", text) and shuffles(text) == 0
    linear = plan(table.select("id", heads.score("x", heads.Head(4, 0, np.zeros(5)))))
    assert "Python" not in linear


@pytest.mark.parametrize(("literal", "python"), [(256, 0), (0, 1)])
def test_encode_with_a_complete_head_is_narrow(table, literal, python, monkeypatch):
    monkeypatch.setattr(vocab, "LITERAL_TOKENS", literal)
    tokens = S.smiles_tokens(F.col("smiles"))
    encoded = vocab.encode(table, "id", tokens, vocab.build_vocabulary(table, tokens))
    text = plan(encoded)
    assert shuffles(text) == 0 and len(re.findall("ArrowEvalPython", text)) == python
