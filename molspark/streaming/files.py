"""Validate, tokenize and score molecules that arrive as files.

These operators are row transforms without state, so the batch functions take a streaming
DataFrame as they are. A file stream with a checkpoint processes each file once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from molspark.functions.smiles import smiles_tokens
from molspark.operators.molecules import validate


def stream_files(
    spark: SparkSession,
    source: str,
    schema: str,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    max_files: int | None = None,
) -> StreamingQuery:
    """Run ``transform`` over the parquet files of ``source`` that have not been seen yet."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (
        transform(reader.parquet(source))
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def tokenize_accepted(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """Add the tokens and the validation verdict of each row; works on tables and streams."""
    return validate(df, smiles).withColumn("tokens", smiles_tokens(F.col(smiles)))
