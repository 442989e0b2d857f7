"""From raw documents to token ids, in five stages that each read what the one before wrote.

Every stage works on all rows of its predecessor, and all but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molspark.llm import bpe, exact_dedup, langid, mixing, near_dedup
from molspark.llm.common import read_table
from molspark.session import materialize, ship_package

#: Similarity from which documents are near copies; op5_near_dedup has a threshold of its own.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter. The model
    learns from the documents that name their language."""
    ship_package(spark)
    pieces = langid.piece_vocabulary(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    model = langid.fit(docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang"), pieces)
    told = langid.predict(docs, model, lang_pred="__lang_pred", score="__lang_score")
    return told.where(F.col("__lang_pred") != langid.UNDETERMINED).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the largest doc_id of each text."""
    ship_package(spark)
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the least doc_id of each group of near-duplicates, which have at least
    ``NEAR_PERCENT`` of their five-word shingles in common."""
    ship_package(spark)
    return near_dedup.keep_one(docs, NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the domains of the labels table get their target shares.
    Documents that most likely belong to a wanted domain stay at least once: that bound is part of
    the fit."""
    ship_package(spark)
    labels = mixing.quality_domains(read_table(spark, sf_dir, "labels"))
    return mixing.repeated(docs, labels, mixing.TARGETS)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, next to its columns."""
    ship_package(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("language", identify_language),
    ("copies", drop_copies),
    ("near-copies", drop_near_copies),
    ("mix", mix),
    ("bpe", encode_bytes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages learn and draw by methods that SQL cannot express; tests/llm checks their rows.
ORACLE_SQL = None
