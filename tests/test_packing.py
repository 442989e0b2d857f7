from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from molspark.operators.packing import best_fit, pack_sequences, packing_check, packing_waste
from pyspark.sql import functions as F


def one_by_one(lengths, budget):
    spaces = []
    for length in sorted(lengths, reverse=True):
        fits = [s for s in spaces if s >= length]
        if fits:
            spaces.remove(min(fits))
        spaces.append((min(fits) if fits else budget) - length)
    return Counter(spaces)


@given(st.integers(1, 30).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(1, b), max_size=60))))
@settings(max_examples=300, deadline=None)
def test_equals_best_fit_of_single_sequences(case):
    budget, lengths = case
    packs = best_fit(Counter(lengths), budget)
    spaces, seen = Counter(), Counter()
    for items, n in packs:
        spaces[budget - sum(size * m for size, m in items)] += n
        for size, m in items:
            seen[size] += n * m
    assert spaces == one_by_one(lengths, budget)
    assert seen == Counter(lengths)


def test_work_does_not_grow_with_the_rows():
    packs = best_fit({size: 10**12 + size for size in range(1, 513)}, 512)
    assert len(packs) <= 4 * 512
    assert sum(n * m for items, n in packs for _, m in items) == sum(10**12 + s for s in range(1, 513))


def test_rows_are_placed_once(spark):
    # a third of the rows share a length; some are empty, null or too long, and keys repeat
    size = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 37 % 40 + 1)
    size = F.when(F.col("id") % 50 == 1, 0).when(F.col("id") % 50 == 2, None).when(F.col("id") % 50 == 4, 100).otherwise(size)
    df = spark.range(3000).select(F.floor(F.col("id") / 2).alias("k"), size.alias("n"), F.lit("x").alias("pack_id"))
    packed = pack_sequences(df, "k", "n", 64).cache()
    assert packed.columns == ["k", "n", "pack_id", "pack_offset", "pack_overflow"]
    rows = packed.collect()
    assert Counter((r.k, r.n) for r in rows) == Counter(map(tuple, df.select("k", "n").collect()))
    assert all((r.pack_id is None) == (r.n is None or r.n == 0) for r in rows)
    assert all(r.pack_overflow == (r.n == 100) for r in rows)
    places = Counter((r.pack_id, p) for r in rows if r.n for p in range(r.pack_offset, r.pack_offset + r.n))
    assert max(places.values()) == 1
    assert max(p for (_, p) in places if _ is not None and p < 64) == 63
    assert all(r.pack_offset + r.n <= 64 for r in rows if r.n and r.n <= 64)
    alone = Counter(r.pack_id for r in rows)
    assert all(alone[r.pack_id] == 1 for r in rows if r.n == 100)
    ids = {r.pack_id for r in rows} - {None}
    assert ids == set(range(len(ids)))
    got = packing_check(packed, "n", 64).collect()[0]
    assert (got.n_rows, got.n_placed, got.n_beyond, got.n_misplaced) == (3000, 2880, 0, 0)
    waste = {r.n_tokens: r.n_packs for r in packing_waste(packed, "n", 64).collect()}
    assert {64 - s: n for s, n in one_by_one([r.n for r in rows if r.n and r.n <= 64], 64).items()} == waste


@pytest.mark.parametrize("values", [[], [(1, 0)], [(1, None)], [(1, 9)]])
def test_nothing_to_pack(spark, values):
    rows = pack_sequences(spark.createDataFrame(values, "k long, n int"), "k", "n", 8).collect()
    assert [r.pack_id for r in rows] == [0 if n == 9 else None for _, n in values]


def test_same_under_any_partitioning(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 9 + 1).alias("n"))
    one, other = (sorted(map(tuple, pack_sequences(df.repartition(p), "k", "n", 16).collect())) for p in (1, 7))
    assert one == other
