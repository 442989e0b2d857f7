"""Property trends along chemical series.

Every check first aggregates values by (property, family, chain length), which Spark
combines per task; only that small table is ordered or compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The three characteristic temperatures in their expected order.
TEMPERATURES = ("Melting Point", "Flash Point", "Boiling Point")


def unwrap_prediction(df: DataFrame, column: str, name: str = "property", value: str = "value") -> DataFrame:
    """Flatten ``map<string, struct<value>>`` with exactly one key into two columns."""
    single = F.when(F.size(column) == 1, F.map_entries(column)[0]).otherwise(
        F.raise_error(F.lit(f"{column} must hold exactly one property"))
    )
    kept = [c for c in df.columns if c != column]
    return df.withColumn("_e", single).select(
        *kept, F.col("_e.key").alias(name), F.col("_e.value.value").alias(value)
    )


def trend_table(df: DataFrame, along: str = "carbons", value: str = "value") -> DataFrame:
    """(property, family, chain length): mean, range and count of the values."""
    return df.groupBy("property", "family", along).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )


def trend_check(trend: DataFrame, along: str = "carbons", digits: int = 9) -> DataFrame:
    """Does the mean value rise strictly with chain length, per property and family?

    Takes a trend table, where a group has one row per chain length. Means are rounded to
    ``digits`` decimals before they are compared, so summation order cannot decide.
    """
    series = Window.partitionBy("property", "family").orderBy(along)
    point = F.round("mean_value", digits)
    steps = trend.filter("n > 0").withColumn("_point", point).withColumn("_last", F.lag("_point").over(series))
    broken = F.col("_point") <= F.col("_last")
    return steps.groupBy("property", "family").agg(
        F.count("*").alias("n_points"),
        F.count_if(broken).alias("violations"),
        F.regr_slope(F.col("_point"), F.col(along).cast("double")).alias("slope"),
        (F.count_if(broken) == 0).alias("monotone"),
    )


def family_compare(
    df: DataFrame,
    on: str = "carbons",
    upper: str = "alcohol",
    lower: str = "alkene",
    digits: int = 9,
) -> DataFrame:
    """Compare two families at equal chain length; ``on`` is the label or the counted carbons.

    Both means come from one conditional aggregation, so values are never paired. Chain
    lengths with only one family are dropped.
    """
    def mean_of(family: str) -> Column:
        return F.avg(F.when(F.col("family") == family, F.col("value")))

    sides = df.groupBy("property", on).agg(
        F.round(mean_of(upper), digits).alias(f"{upper}_value"),
        F.round(mean_of(lower), digits).alias(f"{lower}_value"),
    )
    delta = F.col(f"{upper}_value") - F.col(f"{lower}_value")
    return sides.filter(delta.isNotNull()).withColumn("delta", delta).withColumn("holds", F.col("delta") > 0)


def property_order(df: DataFrame, key: str, order: Sequence[str] = TEMPERATURES, value: str = "value") -> DataFrame:
    """One row per molecule with its properties side by side and whether they rise in order.

    ``ordered`` is null when a property is missing. The properties are named, so the pivot
    is one conditional aggregation with a single shuffle.
    """
    wide = df.groupBy(key).agg(*[F.avg(F.when(F.col("property") == p, F.col(value))).alias(p) for p in order])
    rising = F.lit(True)
    for low, high in zip(order, order[1:]):
        rising = rising & (F.col(f"`{low}`") < F.col(f"`{high}`"))
    complete = F.lit(True)
    for name in order:
        complete = complete & F.col(f"`{name}`").isNotNull()
    return wide.withColumn("ordered", F.when(complete, rising))
