"""Fitted heads and vocabularies as small parquet tables."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from molspark.operators.heads import Head

_VOCABULARY = "token string, n bigint, id int"


def save_head(spark: SparkSession, head: Head, path: str, config: dict | None = None) -> None:
    """Write weights, shape, loss history and an optional run configuration as one row."""
    row = (
        head.dim,
        head.num_hidden_layers,
        [float(w) for w in head.weights],
        list(head.history),
        list(head.eval_history),
        head.best_epoch,
        json.dumps(config or {}, sort_keys=True),
    )
    schema = """dim int, num_hidden_layers int, weights array<double>, history array<double>,
        eval_history array<double>, best_epoch int, config string"""
    spark.createDataFrame([row], schema).write.mode("errorifexists").parquet(path)


def load_head(spark: SparkSession, path: str) -> Head:
    row = spark.read.parquet(path).first()
    return Head(
        row["dim"],
        row["num_hidden_layers"],
        np.array(row["weights"]),
        tuple(row["history"]),
        tuple(row["eval_history"]),
        row["best_epoch"],
    )


def load_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(path).first()["config"])


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.select("token", "n", "id").write.mode("errorifexists").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_VOCABULARY).parquet(path)
