"""CSV and parquet tables with declared schemas."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
# Rows of a task that does heavy work by row: at least, so that tasks are worth their start, and about
# at most.
LEAST_ROWS, MOST_ROWS = 1_000, 50_000


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    """Read CSV lines of a declared schema; lines that do not fit keep their text in ``_corrupt_record``.

    Every line is parsed as a whole, so a line is corrupt or not whatever columns are asked for
    later, and counts need no cache. A field may not contain a line break. With ``header`` the
    first line must name the columns in order, and every line that repeats it is left out; blank
    lines are skipped. No pass over the data is spent on inferring types.
    """
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = T.StructType([*declared.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    if header:
        title = F.from_csv("value", ", ".join(f"`{n}` string" for n in declared.names))
        first = lines.select(title.alias("t"), "value").first()
        if first is not None and list(first["t"]) != declared.names:
            raise ValueError(f"the first line does not name the columns {declared.names}: {first['value']}")
        is_title = [F.coalesce(title[n] == n, F.lit(False)) for n in declared.names]
        lines = lines.where(~functools.reduce(lambda x, y: x & y, is_title))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return lines.select(F.from_csv("value", ddl, options).alias("row")).select("row.*")


def infer_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read CSV files with types inferred from the data, at the price of a second pass."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the marker column, corrupt rows) of a table from :func:`read_csv`."""
    bad = F.col(CORRUPT).isNotNull()
    return df.filter(~bad).drop(CORRUPT), df.filter(bad)


def spread(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``df`` with its rows dealt evenly to tasks, for heavy work by row on tables whose files hold few
    pieces that can be read apart. The number of tasks follows the rows, about ``most`` a task at most
    and four tasks a core at least."""
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    tasks = min(math.ceil(rows / LEAST_ROWS), max(4 * cores, math.ceil(rows / most)))
    return df.repartition(max(tasks, 1))


def spread_large(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """``df`` of a table's files as it is, unless one piece of them that can only be read as a whole has
    more rows than an even share of a core; then its rows are dealt to tasks of about ``most`` rows.

    Pieces are counted by the files' own row counts, without a column. Rows are dealt by a hash of
    their place, which needs no sort of the rows."""
    pieces = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("piece")).count().collect()]
    rows, cores = sum(pieces), df.sparkSession.sparkContext.defaultParallelism
    tasks = min(math.ceil(rows / LEAST_ROWS), max(4 * cores, math.ceil(rows / most)))
    if tasks <= len(pieces) or max(pieces) * cores <= rows:
        return df
    return df.repartition(tasks, F.monotonically_increasing_id())


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_predictions(df: DataFrame, path: str, by: str = "property") -> None:
    """Write scored rows partitioned by ``by``, so readers of one property skip the others."""
    df.write.mode("errorifexists").partitionBy(by).parquet(path)


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_split(df: DataFrame, path: str, split: str = "split") -> None:
    """Write a split table partitioned by side; a filter on the side then prunes files."""
    df.write.mode("errorifexists").partitionBy(split).parquet(path)


def write_quarantine(checked: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write a validated table once, partitioned by ``accepted``; return (accepted, rejected)."""
    marked = checked.withColumn("accepted", F.size("reasons") == 0)
    marked.write.mode("errorifexists").partitionBy("accepted").parquet(path)
    stored = checked.sparkSession.read.schema(marked.schema).parquet(path)
    return tuple(stored.filter(F.col("accepted") == side).drop("accepted") for side in (True, False))
