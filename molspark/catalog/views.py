"""Input tables of the registered queries, derived from the shared parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molspark.functions import smiles as S
from molspark.functions.vectors import dot, linear
from molspark.operators.joins import score_registry
from molspark.sources.tables import spread

# Example strings with the expected verdict of the lexical checks.
EXAMPLES = [
    ("CCO", "ok"),
    ("C=CC", "ok"),
    ("C1CCCCC1", "ok"),
    ("c1ccccc1", "aromatic"),
    ("C[C@@H](N)C(=O)[O-]", "ok"),
    ("[13CH4]", "ok"),
    ("ClCCBr", "ok"),
    ("C%12CCCCC%12", "ok"),
    ("[Na+].[Cl-]", "ok"),
    ("Cn1cnc2c1c(=O)n(C)c(=O)n2C", "aromatic"),
    ("C(C", "paren"),
    ("[Na+", "bracket"),
    ("C1CC", "ring"),
    ("", "empty"),
    ("C$?C", "charset"),
    ("CC=", "dangling"),
]

# Endings for chains, some of which their last atom cannot hold.
ENDINGS = ["", "C(C)(C)C", "=C", "F", "(C)(C)(C)C", ".[Na+]", "c1ccccc1", "C(=O)[O-]"]

# The example registry; value = base + slope * carbons + noise * (label - 950).
REGISTRY = [
    {"property": "Boiling Point", "model": "line-bp", "base": 0.0, "slope": 9.0, "noise": 0.05},
    {"property": "Flash Point", "model": "line-fp", "base": -60.0, "slope": 7.0, "noise": 0.10},
    {"property": "Melting Point", "model": "line-mp", "base": -150.0, "slope": 6.0, "noise": 3.00},
]

# Whole texts and their tokens that a task holds stay few, however many there are in all.
DOCUMENTS_A_TASK = 4_000

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mol_id, family, carbons, smiles, label, source: a molecule per part."""
    n = F.col("p_size")
    even = F.col("p_partkey") % 2 == 0
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("mol_id"),
        F.when(even, "alkene").otherwise("alcohol").alias("family"),
        n.cast("int").alias("carbons"),
        F.when(even, S.alkene_smiles(n)).otherwise(S.alcohol_smiles(n)).alias("smiles"),
        F.col("p_retailprice").alias("label"),
        F.col("p_brand").alias("source"),
    )


def mixed_smiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mol_id, smiles, expect, source: the example strings at the size of the part table."""
    rows = F.array(
        *[F.struct(F.lit(s).alias("smiles"), F.lit(e).alias("expect")) for s, e in EXAMPLES]
    )
    position = (F.col("p_partkey") % len(EXAMPLES) + 1).cast("int")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("mol_id"),
        F.element_at(rows, position).alias("_e"),
        F.col("p_brand").alias("source"),
    ).select("mol_id", "_e.smiles", "_e.expect", "source")


def ended_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mol_id, carbons, smiles, source: the molecules with one of ``ENDINGS`` behind their last atom."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("mol_id") % len(ENDINGS) + 1).cast("int"))
    return molecules(spark, sf_dir).select("mol_id", "carbons", F.concat("smiles", ending).alias("smiles"), "source")


def aromatic_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mol_id, kind, rings, smiles: by part key, chains of benzenes, fused benzenes, chains of
    thiophenes, five-membered carbon rings (which have no Kekulé form), and chains without rings."""
    k, kind = (F.col("p_size") % 6 + 1).cast("int"), F.col("p_partkey") % 5
    one = F.lit(1)
    labels = F.when(k > 2, F.sequence(F.lit(3), F.greatest(k, F.lit(3)))).otherwise(F.array().cast("array<int>"))
    down = F.when(k > 2, F.sequence(F.greatest(k, F.lit(3)) - 1, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    step = lambda i: F.concat(F.lit("cc"), i.cast("string"))
    fused = F.concat(
        F.lit("c1ccc2"), F.array_join(F.transform(labels, step), ""), F.lit("ccccc"), k.cast("string"), F.array_join(F.transform(down, step), ""), F.lit("c1")
    )
    smiles = (
        F.when(kind == 0, F.concat(F.repeat(F.lit("c1ccc("), k - one), F.lit("c1ccccc1"), F.repeat(F.lit(")cc1"), k - one)))
        .when(kind == 1, F.when(k == 1, F.lit("c1ccccc1")).otherwise(fused))
        .when(kind == 2, F.repeat(F.lit("c1ccc(s1)"), k))
        .when(kind == 3, F.repeat(F.lit("c1cccc1"), k))
        .otherwise(S.alkene_smiles(F.col("p_size")))
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mol_id"), kind.cast("int").alias("kind"), k.alias("rings"), smiles.alias("smiles"))


def property_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mol_id, family, carbons, property, value: each molecule with each registry model."""
    model = F.col("model")
    value = F.round(
        model["base"] + model["slope"] * F.col("carbons") + (F.col("label") - 950) * model["noise"], 6
    )
    scored = score_registry(
        molecules(spark, sf_dir).select("mol_id", "family", "carbons", "label"), REGISTRY, value
    )
    return scored.select("mol_id", "family", "carbons", model["property"].alias("property"), "value")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_key, grp, y, y_pred: a prediction per line item."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", *LINE_KEY).alias("row_key"),
        F.col("l_returnflag").alias("grp"),
        F.col("l_extendedprice").alias("y"),
        linear([F.col("l_extendedprice"), F.col("l_quantity")], [0.9, 100.0]).alias("y_pred"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study, trial_id, value: an objective per event; ties are intended."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("study"),
        F.col("event_id").alias("trial_id"),
        F.floor("value").cast("double").alias("value"),
    )


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, epoch, sq_err: a squared error per event; an epoch is a day."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("epoch"),
        F.col("value").alias("sq_err"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text; spread over the cores because every use of it tokenizes whole texts."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), DOCUMENTS_A_TASK)


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, lang, source, quality: documents, with the quality label where there is one."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id", "left")


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, embedding, target: a target that is linear in the vector."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", dot(F.col("embedding"), range(1, 65)).alias("target")
    )
