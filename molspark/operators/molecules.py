"""Molecule tables: homologous series, lexical validation, aromatic audit, label checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molspark.functions import smiles as S

FAMILIES = {"Alkene": "alkene", "Alcohol": "alcohol"}


def _family_row(title: str, n: Column, compat: bool) -> Column:
    text = S.alkene_smiles(n) if title == "Alkene" else S.alcohol_smiles(n, compat)
    return F.struct(
        F.lit(FAMILIES[title]).alias("family"),
        S.chain_name(n, title).alias("name"),
        n.cast("int").alias("carbons"),
        text.alias("smiles"),
    )


def series_of(df: DataFrame, chain_length: Column, family: str, compat: bool = True) -> DataFrame:
    """Add family, name, carbons and smiles of one family ("Alkene" or "Alcohol") to each row."""
    row = _family_row(family, chain_length, compat)
    return df.withColumn("_s", row).select(*df.columns, "_s.*")


def expand_series(df: DataFrame, chain_lengths: Column, compat: bool = True) -> DataFrame:
    """One row per family and chain length for each input row; a single narrow pass."""
    lengths = df.withColumn("_n", F.explode(chain_lengths))
    both = F.array(*[_family_row(title, F.col("_n"), compat) for title in FAMILIES])
    return lengths.withColumn("_s", F.explode(both)).select(*df.columns, "_s.*")


def homologous_series(
    spark: SparkSession, low: int = 2, high: int = 24, step: int = 2, compat: bool = True
) -> DataFrame:
    """Alkenes and alcohols for chain labels low, low + step, ..., up to and including high."""
    labels = spark.range(low, high + 1, step).withColumnRenamed("id", "_label")
    return expand_series(labels, F.array("_label"), compat).drop("_label")


def validate(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """Add ``reasons`` (why a row is rejected), ``has_aromatic`` and ``verdict``.

    ``verdict`` is the first reason, or ``aromatic`` for an accepted row in aromatic
    notation, or ``ok``. Lexical checks only.
    """
    text, skeleton = F.col(smiles), F.col("_skeleton")
    checked = df.withColumn("_skeleton", S.skeleton_of(text)).withColumns(
        {
            "reasons": S.reject_reasons(text, skeleton),
            "has_aromatic": S.aromatic_atoms(text, skeleton) > 0,
        }
    )
    verdict = (
        F.when(F.size("reasons") > 0, F.col("reasons")[0])
        .when(F.col("has_aromatic"), F.lit("aromatic"))
        .otherwise(F.lit("ok"))
    )
    return checked.withColumn("verdict", verdict).drop("_skeleton")


def is_accepted() -> Column:
    return F.size("reasons") == 0


def quarantine(df: DataFrame, smiles: str = "smiles", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) tables of one projection.

    A job that reads both should store them with ``sources.tables.write_quarantine``, which
    validates once. With ``strict`` the first rejected row fails the job that reads the accepted table.
    """
    checked = validate(df, smiles)
    if strict:
        message = F.concat(F.lit("invalid SMILES: "), F.coalesce(F.col(smiles), F.lit("null")))
        guard = F.when(is_accepted(), True).otherwise(F.raise_error(message).cast("boolean"))
        return checked.filter(guard), checked.limit(0)
    return checked.filter(is_accepted()), checked.filter(~is_accepted())


def validation_report(checked: DataFrame) -> DataFrame:
    """(accepted, verdict, n_rows); the counts add up to the input."""
    return checked.groupBy(is_accepted().alias("accepted"), "verdict").agg(
        F.count("*").alias("n_rows")
    )


def aromatic_audit(df: DataFrame, group: str, smiles: str = "smiles") -> DataFrame:
    """Per group: rows, rows in aromatic notation, aromatic atoms, and the share of rows."""
    atoms = S.aromatic_atoms(F.col(smiles))
    return (
        df.select(group, atoms.alias("_atoms"))
        .groupBy(group)
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if(F.col("_atoms") > 0).alias("n_aromatic"),
            F.sum("_atoms").cast("bigint").alias("aromatic_atoms"),
        )
        .withColumn("share", F.col("n_aromatic") / F.col("n_rows"))
    )


def carbon_mismatch(df: DataFrame, carbons: str = "carbons", smiles: str = "smiles") -> DataFrame:
    """Rows whose carbon label differs from the carbons in the string."""
    counted = df.withColumn("carbon_count", S.carbon_count(F.col(smiles)))
    return counted.filter(F.col(carbons) != F.col("carbon_count"))
