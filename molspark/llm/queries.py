"""The registered queries of this subpackage: (spark, folder of the tables) to DataFrame."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molspark.llm import bpe, conversation_repair, exact_dedup, fingerprint, hard_negatives, html_extract, langid, license_scan, maxent_lm, mixing, near_dedup, quality, url_filter
from molspark.llm.common import crc_bucket, read_table
from molspark.session import materialize, ship_package
from molspark.sources.tables import spread_large

Query = Callable[[SparkSession, str], DataFrame]

_REGISTERED: dict[str, Query] = {}


def register(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    _REGISTERED[query.__name__] = run
    return run


def all_queries() -> dict[str, Query]:
    return dict(_REGISTERED)


@register
def op1_byte_bpe(spark, sf):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = spread_large(read_table(spark, sf, "documents").select("doc_id", "text"), bpe.TASK_ROWS)
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(encoded, ranks).select("doc_id", *bpe.digests())


URL_RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]


@register
def op2_url_filter(spark, sf):
    return url_filter.judge(read_table(spark, sf, "pages"), URL_RULES)


@register
def op3_language_id(spark, sf):
    docs = read_table(spark, sf, "documents")
    held_out = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    learned = docs.where((crc_bucket("doc_id", 4) != 2) & F.col("lang").isNotNull())
    pieces = langid.piece_vocabulary(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    model = langid.fit(learned.select("doc_id", "text", "lang"), pieces)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return langid.predict(rows, model).drop("text")


@register
def op4_license_scan(spark, sf):
    return license_scan.scan_licenses(read_table(spark, sf, "documents"))


@register
def op5_near_dedup(spark, sf):
    return near_dedup.near_duplicates(read_table(spark, sf, "documents"))


@register
def op6_exact_dedup(spark, sf):
    return exact_dedup.exact_groups(read_table(spark, sf, "documents"))


@register
def op7_mix_sources(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    marks = mixing.quality_domains(read_table(spark, sf, "labels"))
    classifier = mixing.fit_classifier(docs, marks, list(mixing.TARGETS))
    scored = materialize(mixing.with_posteriors(docs, classifier).drop("text"), "posteriors")
    return mixing.with_rates(scored, mixing.fit_rates(scored, classifier, mixing.TARGETS))


@register
def op8_fingerprint(spark, sf):
    return fingerprint.neighbour_fingerprints(read_table(spark, sf, "documents"))


@register
def op9_html_extract(spark, sf):
    pages = read_table(spark, sf, "pages").select("page_id", "url", "html")
    found = html_extract.extract(pages, html_extract.fit(pages))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@register
def op10_lm_score(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    learned = docs.where(crc_bucket("doc_id", 7) != 2)
    model, counts = maxent_lm.fit(learned)
    held_out = F.coalesce(crc_bucket("doc_id", 7) == 2, F.lit(False))
    return maxent_lm.score(docs.withColumn("held_out", held_out), model, counts)


@register
def op11_hard_negatives(spark, sf):
    rows = read_table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), hard_negatives.quantised("embedding").alias("vector"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


@register
def op12_quality(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    stats = materialize(quality.with_statistics(docs), "statistics")
    marks = read_table(spark, sf, "labels").where(crc_bucket("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("target"))
    model = quality.fit(stats.join(marks, "doc_id").withColumnRenamed("doc_id", "id"))
    held_out = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    told = quality.score(stats.select("doc_id", held_out.alias("held_out"), "stats"), model)
    return told.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@register
def op13_conversation_repair(spark, sf):
    return conversation_repair.repair(conversation_repair.damage(read_table(spark, sf, "conversations")), "copies")
