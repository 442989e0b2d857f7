"""Exact deduplication against an immutable snapshot.

A snapshot is a table of groups (digest, keep_id, copies) in hash buckets, with one static
binary fuse filter per bucket. An incoming batch is first grouped by itself; the digests of its
groups are screened by the filter of their bucket, and only positives are joined with the exact
groups. The bytes of all texts that share a digest are then compared, and texts that differ
although their digests agree are grouped by the text itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molspark.llm import binary_fuse
from molspark.llm.common import text_or_empty
from molspark.session import materialize

#: Digests of one filter, on average; a bucket is what one task holds.
KEYS_PER_FILTER = 50_000
#: Tasks that compare the texts of one group, which may hold a large part of all rows.
SALTS = 32


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@dataclass
class Snapshot:
    groups: DataFrame  # bucket, digest, keep_id, copies
    filters: DataFrame  # bucket, seed, segment, segments, cells
    n_buckets: int


def _bucket(n_buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).cast("int")


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("copies"))


def build_snapshot(rows: DataFrame, n_buckets: int | None = None) -> Snapshot:
    """Group rows (doc_id, digest) and build the filters; groups and filters are written once."""
    groups = _grouped(rows)
    if n_buckets is None:
        groups = materialize(groups, "dedup-groups")
        n_buckets = max(1, math.ceil(groups.count() / KEYS_PER_FILTER))
    groups = groups.withColumn("bucket", _bucket(n_buckets))
    groups = materialize(groups, "dedup-snapshot")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        made = binary_fuse.build(pdf["key"].to_numpy())
        return pd.DataFrame(
            {"bucket": [key[0]], "seed": [str(made.seed)], "segment": [made.segment], "segments": [made.segments], "cells": [made.cells.tobytes()]}
        )

    keys = groups.select("bucket", F.xxhash64("digest").alias("key"))
    filters = keys.groupBy("bucket").applyInPandas(build, "bucket int, seed string, segment long, segments long, cells binary")
    return Snapshot(groups, materialize(filters, "dedup-filters"), n_buckets)


def screen(snapshot: Snapshot, groups: DataFrame) -> DataFrame:
    """The groups of a batch (digest, ...) with ``maybe``: false only if the snapshot lacks the
    digest. Digests meet their bucket's filter in one co-grouped task per bucket."""

    def ask(key: tuple, filters: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        maybe = np.zeros(len(asked), bool)
        if len(filters):
            f = filters.iloc[0]
            cells = np.frombuffer(f["cells"], np.uint8)
            maybe = binary_fuse.BinaryFuse(int(f["seed"]), int(f["segment"]), int(f["segments"]), cells).contains(asked["key"].to_numpy())
        return pd.DataFrame({"digest": asked["digest"], "maybe": maybe})

    asked = groups.select("digest", F.xxhash64("digest").alias("key"), _bucket(snapshot.n_buckets).alias("bucket"))
    answers = snapshot.filters.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(ask, "digest string, maybe boolean")
    return answers


def _merge(snapshot: Snapshot, batch: DataFrame) -> DataFrame:
    """Groups (digest, keep_id, copies) over the snapshot and the grouped batch together."""
    answers = materialize(screen(snapshot, batch), "dedup-answers")
    positives = answers.where("maybe").select("digest")
    met = batch.join(positives, "digest", "left_semi")
    old = snapshot.groups.select("digest", "keep_id", "copies")
    both = old.unionByName(met).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))
    new = batch.join(positives, "digest", "left_anti")
    return both.unionByName(new)


def exact_groups(docs: DataFrame, digest=sha256_of, n_buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the largest doc_id stays; null ids sort below
    all others, and a group of null ids alone has no keep_id and keeps nothing by id. Rows that
    repeat an id and its text are copies of each other that all carry ``kept``. An empty table
    gives an empty one; other columns are ignored.

    One half of the rows, by a hash of the id, makes the snapshot and the other half the
    incoming batch, so both ways of finding copies are taken at every size. Groups are
    pre-aggregated per task; a hot text reaches its group as one row per task.
    """
    texts = docs.select(F.col("doc_id"), text_or_empty("text").alias("text"))
    rows = texts.select("doc_id", digest(F.col("text")).alias("digest"), sha256_of(F.col("text")).alias("text_sha256"))
    rows = materialize(rows.withColumn("incoming", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1), "dedup-rows")
    snapshot = build_snapshot(rows.where(~F.col("incoming")), n_buckets)
    batch = materialize(_grouped(rows.where("incoming")), "dedup-batch")
    groups = materialize(_merge(snapshot, batch), "dedup-merged")

    salted = texts.select(digest(F.col("text")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"), "text")
    several = groups.where("copies > 1").select("digest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    found = salted.join(several, ["digest", "salt"]).groupBy("digest", "salt").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    sides = found.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    differing = materialize(sides.where("low != high").select("digest"), "dedup-differing")
    if differing.isEmpty():
        judged = rows.join(groups, "digest")
    else:
        judged = _by_text(rows, texts.withColumn("digest", digest(F.col("text"))), groups, differing)
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return judged.select("doc_id", "keep_id", F.col("copies").alias("group_size"), kept.alias("kept"), "text_sha256")


def _by_text(rows: DataFrame, texts: DataFrame, groups: DataFrame, differing: DataFrame) -> DataFrame:
    """As the plain join, but rows under a digest that several texts share are grouped by text."""
    alike = rows.join(differing, "digest", "left_anti").join(groups, "digest")
    apart = texts.join(differing, "digest", "left_semi")
    by_text = apart.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("copies"))
    again = apart.join(by_text, ["digest", "text"]).withColumn("text_sha256", sha256_of(F.col("text")))
    columns = ["doc_id", "keep_id", "copies", "text_sha256"]
    return alike.select(columns).unionByName(again.select(columns))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one per distinct text.

    Rows of equal id and text are told apart by nothing and are reduced to one by ``dropDuplicates``.
    Rows without an id stay only where no copy has one.
    """
    groups = exact_groups(docs)
    kept = groups.groupBy("text_sha256").agg(F.max("doc_id").alias("__dedup_keep"))
    marked = docs.withColumn("__dedup_digest", sha256_of(text_or_empty("text")))
    stays = marked.join(kept.withColumnRenamed("text_sha256", "__dedup_digest"), "__dedup_digest").where(F.col("doc_id").eqNullSafe(F.col("__dedup_keep")))
    return stays.dropDuplicates(["__dedup_digest"]).select(docs.columns)
