import hashlib
import math

import pytest
from pyspark.sql import functions as F

from molspark.functions.hashing import content_key, seeded_hash, seeded_uniform
from molspark.operators import ranking, splits
from molspark.operators.checks import assert_unique, duplicate_keys, split_overlap, split_partition_check


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def expected_order(ids, seed=42):
    return sorted(ids, key=lambda i: md5(f"{seed}:{i}"))


def test_seeded_hash_and_uniform(spark):
    row = spark.range(7, 8).select(seeded_hash("id").alias("h"), seeded_uniform("id").alias("u")).first()
    assert row.h == md5("42:7")
    assert row.u == int(md5("42:7")[:13], 16) / 2**52


def test_composite_keys_do_not_collide(spark):
    rows = [(None, "a"), ("a", None), ("a:b", "c"), ("a", "b:c"), ("a\\", "b"), ("a", "\\b"), ("\\N", "a"), ("", "a")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(seeded_hash(["x", "y"]).alias("h")).distinct().count() == len(rows)
    assert spark.range(7, 8).select(seeded_hash(["id", F.lit("k")]).alias("h")).first().h == md5("42:7:k")


def test_content_key_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "x string, y string")
    keys = [r.k for r in df.select(content_key(["x", "y"]).alias("k")).collect()]
    assert keys[0] == keys[2] != keys[1]


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
@pytest.mark.parametrize("digits", [None, 2, 4])
def test_hash_rank_is_exact(spark, n, digits):
    ranked = ranking.hash_rank(spark.range(n), "id", digits=digits)
    found = {r.id: r["rank"] for r in ranked.collect()}
    assert found == {i: pos for pos, i in enumerate(expected_order(range(n)), 1)}


def test_hash_rank_does_not_depend_on_layout(spark):
    a = ranking.hash_rank(spark.range(500), "id").orderBy("id").collect()
    b = ranking.hash_rank(spark.range(500).repartition(7), "id").orderBy("id").collect()
    assert a == b


@pytest.mark.parametrize("n", [0, 1, 777])
def test_sorted_rank_is_exact(spark, n):
    df = spark.range(n).select("id", (F.col("id") * 37 % 101).alias("v"))
    ranked = ranking.sorted_rank(df, [F.col("v").desc(), F.col("id")], partitions=5)
    found = {r.id: r["rank"] for r in ranked.collect()}
    order = sorted(range(n), key=lambda i: (-(i * 37 % 101), i))
    assert found == {i: pos for pos, i in enumerate(order, 1)}


@pytest.mark.parametrize("k", [0, 1, 2, 333, 999, 1000, 5000])
def test_hash_cutoff_selects_the_smallest(spark, k):
    chosen = {r.id for r in ranking.head_by_hash(spark.range(1000), "id", k).collect()}
    assert chosen == set(expected_order(range(1000), "42:subset")[:k])


@pytest.mark.parametrize("k", [1, 700, 1400, 2100])
def test_cutoff_with_a_hot_key_takes_the_histogram(spark, k):
    # A third of the rows share one key, so the boundary is far from the k / n quantile.
    keys = [-1] * 700 + list(range(1400))
    df = spark.createDataFrame([(i,) for i in keys], "key int")
    cutoff = ranking.hash_cutoff(df, "key", k)
    assert cutoff.digest == sorted(md5(f"42:{i}") for i in keys)[k - 1]


def test_three_way_split_is_exact_disjoint_and_keeps_the_test_side(spark):
    df = spark.range(1003)
    three = {r.id: r.split for r in splits.three_way_split(df, "id", 0.1, 0.2).collect()}
    two = {r.id: r.split for r in splits.train_test_split(df, "id", 0.2).collect()}
    sizes = [sum(v == s for v in three.values()) for s in ("test", "val", "train")]
    assert sizes == [201, 101, 701]
    assert {i for i, s in three.items() if s == "test"} == {i for i, s in two.items() if s == "test"}
    with pytest.raises(ValueError):
        splits.three_way_split(df, "id", 0.6, 0.5)


def test_cutoff_on_empty_table(spark):
    assert ranking.head_by_hash(spark.range(0), "id", 10).count() == 0


def test_cutoff_keeps_equal_keys_together_when_one_key_is_hot(spark):
    ids = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("key")
    df = splits.train_test_split(spark.range(3000).select(ids), "key")
    sides = df.groupBy("key").agg(F.count_distinct("split").alias("n")).filter("n > 1").count()
    assert sides == 0
    assert df.count() == 3000


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 997])
@pytest.mark.parametrize("share", [0.0, 0.07, 0.2, 1.0])
def test_split_sizes_are_exact(spark, n, share):
    df = splits.train_test_split(spark.range(n), "id", share)
    counts = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    test = math.ceil(round(share * 100) * n / 100)
    assert counts.get("test", 0) == test
    assert counts.get("train", 0) == n - test


def test_split_is_seeded_and_layout_free(spark):
    def members(df, seed):
        return {r.id for r in splits.train_test_split(df, "id", 0.2, seed).filter("split = 'test'").collect()}

    assert members(spark.range(300), 1) == members(spark.range(300).repartition(9), 1)
    assert members(spark.range(300), 1) != members(spark.range(300), 2)
    assert members(spark.range(300), 42) == set(expected_order(range(300))[:60])


def test_split_rejects_bad_share(spark):
    with pytest.raises(ValueError):
        splits.train_test_split(spark.range(3), "id", 1.5)


def test_threshold_split_is_stable_under_append(spark):
    small = {r.id: r.split for r in splits.threshold_split(spark.range(200), "id").collect()}
    large = {r.id: r.split for r in splits.threshold_split(spark.range(2000), "id").collect()}
    assert all(large[i] == side for i, side in small.items())
    share = sum(s == "test" for s in large.values()) / 2000
    assert abs(share - 0.2) < 0.04


def test_batches_are_full_but_the_last(spark):
    df = splits.assign_batches(spark.range(101), "id", 32)
    sizes = {r.batch_id: r["count"] for r in df.groupBy("batch_id").count().collect()}
    assert sizes == {0: 32, 1: 32, 2: 32, 3: 5}


def test_number_copies_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_COPY_CHUNK", 7)
    # Key "hot" fills most of the table: 60 identical rows and 40 that differ.
    rows = [("hot", 0)] * 60 + [("hot", i) for i in range(1, 41)] + [("cold", 5), (None, 1), (None, 1)]
    df = spark.createDataFrame(rows, "k string, v int")
    found = ranking.number_copies(df, "k").collect()
    assert sorted((r.k or "", r.v) for r in found) == sorted((k or "", v) for k, v in rows)
    for key, size in (("hot", 100), ("cold", 1), (None, 2)):
        assert sorted(r["copy"] for r in found if r.k == key) == list(range(1, size + 1))


def test_copies_are_expanded_in_tasks_that_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_COPY_CHUNK", 7)
    monkeypatch.setattr(ranking, "_COPY_ROWS", 100)
    df = spark.createDataFrame([("hot", 0)], "k string, v int").withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("_")
    numbered = ranking.number_copies(df, "k")
    assert sorted(r["copy"] for r in numbered.collect()) == list(range(1, 2001))
    sizes = [r["count"] for r in numbered.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 300


def test_numbered_copies_complete_a_key_for_ranking(spark):
    rows = [("a", 1)] * 50 + [("b", 2)] * 3
    df = ranking.number_copies(spark.createDataFrame(rows, "k string, v int"), ["k", "v"])
    ranked = ranking.hash_rank(df, ["k", "v", "copy"])
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 54))


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "id int, v string")
    assert {(r.id, r.n_rows) for r in duplicate_keys(df, "id").collect()} == {(1, 2), (None, 2)}
    with pytest.raises(ValueError, match="not unique"):
        assert_unique(df, "id")
    assert assert_unique(df, "v") is df


def test_partition_check_finds_each_fault(spark):
    rows = spark.range(10)
    good = splits.train_test_split(rows, "id")
    row = split_partition_check(rows, good, "id").first()
    assert (row.n_rows, row.n_train, row.n_test) == (10, 8, 2)
    assert (row.missing_keys, row.extra_keys, row.shared_keys) == (0, 0, 0)
    bad = spark.createDataFrame([(0, "train"), (0, "test"), (99, "train")], "id bigint, split string")
    row = split_partition_check(rows, bad, "id").first()
    assert (row.missing_keys, row.extra_keys, row.shared_keys) == (9, 2, 1)
    empty = split_partition_check(rows.limit(0), good.limit(0), "id").first()
    assert (empty.n_rows, empty.missing_keys) == (0, 0)


def test_overlap_counts_rows_and_values(spark):
    rows = [("C", "train")] * 5 + [("C", "test")] * 2 + [("CC", "train"), ("CCC", "test"), (None, "test"), (None, "train")]
    row = split_overlap(spark.createDataFrame(rows, "smiles string, split string"), "smiles").first()
    assert (row.n_values, row.shared_values, row.shared_train_rows, row.shared_test_rows) == (3, 1, 5, 2)
