import numpy as np
import pytest
from helpers import no_docs, odd_docs
from molspark.llm import binary_fuse, exact_dedup
from pyspark.sql import functions as F


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 30_000])
def test_filter_holds_all_keys_and_few_others(n):
    r = np.random.default_rng(n)
    keys = r.integers(-(2**63), 2**63 - 1, n)
    made = binary_fuse.build(np.concatenate([keys, keys[: n // 2]]))
    assert made.contains(keys).all()
    assert made.contains(r.integers(-(2**63), 2**63 - 1, 50_000)).mean() < 0.006


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    out = []
    for r in rows:
        ids = groups[r["text"] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r["doc_id"], keep, len(ids), r["doc_id"] is not None and r["doc_id"] == keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_of, lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1)])
def test_groups_equal_brute_force_also_with_a_weak_digest(spark, digest):
    docs = odd_docs(spark)
    more = [(100 + i, f"text number {i % 7}", None, None, None, None, None) for i in range(40)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).cache()
    got = exact_dedup.exact_groups(docs, digest, n_buckets=3).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got], key=str) == brute(docs.collect())
    assert exact_dedup.exact_groups(no_docs(spark)).count() == 0


def test_keep_one_has_each_text_once(spark):
    docs = odd_docs(spark)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r["text"] or "" for r in docs.collect()})
    assert exact_dedup.keep_one(no_docs(spark)).count() == 0


def test_screen_never_misses(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"))
    snapshot = exact_dedup.build_snapshot(rows.where("doc_id < 1000"), 4)
    asked = rows.select("doc_id", "digest")
    answers = exact_dedup.screen(snapshot, asked).join(rows, "digest").collect()
    assert len(answers) == 2000
    assert all(r["maybe"] for r in answers if r["doc_id"] < 1000)
    assert sum(r["maybe"] for r in answers if r["doc_id"] >= 1000) < 30
