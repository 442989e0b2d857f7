"""Several properties for the same molecules, and the checks on their trends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from molspark.operators.heads import Head, score_properties
from molspark.operators.trends import family_compare, property_order, trend_check, trend_table

# The properties of the example registry, in display order.
PROPERTIES = ("Boiling Point", "Flash Point", "Melting Point")


@dataclass(frozen=True)
class TrendAnalysis:
    values: DataFrame
    trend: DataFrame
    monotone: DataFrame
    families: DataFrame
    ordered: DataFrame


def analyse_trends(values: DataFrame, key: str, along: str = "carbons") -> TrendAnalysis:
    """Trend table and the three checks over (key, family, chain length, property, value)."""
    trend = trend_table(values, along)
    return TrendAnalysis(
        values, trend, trend_check(trend, along), family_compare(values, along), property_order(values, key)
    )


def predict_and_analyse(
    molecules: DataFrame, key: str, vector: str, heads: dict[str, Head], along: str = "carbons"
) -> TrendAnalysis:
    """Score every molecule with every head in one pass, then analyse the trends."""
    return analyse_trends(score_properties(molecules, vector, heads), key, along)
