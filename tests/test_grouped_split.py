import itertools
import random

import pytest
from pyspark.sql import functions as F

from molspark.operators import grouped_split as S

SCHEMA = "id long, a string, b string, group_rows string"


def by_search(rows):
    """Least id of every row's group, by flooding."""
    ids = {}
    for start in range(len(rows)):
        if start in ids:
            continue
        group, fresh = {start}, [start]
        while fresh:
            _, a, b, *_ = rows[fresh.pop()]
            for j, (_, c, d, *_) in enumerate(rows):
                if j not in group and (a is not None and a == c or b is not None and b == d):
                    group.add(j)
                    fresh.append(j)
        for j in group:
            ids[j] = min(rows[k][0] for k in group), len(group)
    return {rows[j][0]: found for j, found in ids.items()}


def random_rows(seed, n, values):
    rng = random.Random(seed)
    pick = lambda: rng.choice([None, *map(str, range(values))])
    return [(i, pick(), pick(), "clash") for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("n, values", [(60, 40), (120, 200), (50, 3), (1, 1)])
def test_groups_equal_a_flood(spark, n, values):
    rows = random_rows(n, n, values)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.id: (r.group_id, r.group_rows) for r in S.linked_groups(df, "id", ["a", "b"]).collect()}
    assert got == by_search(rows)


def test_a_long_chain_and_a_hot_value(spark):
    rows = [(i, str(i), str(i + 1), "") for i in range(400)] + [(1000 + i, "hot" if i else "7", "hot" if i % 2 else f"x{i}", "") for i in range(3000)]
    got = S.linked_groups(spark.createDataFrame(rows, SCHEMA), "id", ["a", "b"]).groupBy("group_id").count().collect()
    # column a and column b are different kinds of values: "hot" in one does not link it to the other
    assert sorted((r.group_id, r["count"]) for r in got) == sorted({(v[0], v[1]) for v in by_search_fast(rows).values()})


def by_search_fast(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a, b, *_ in rows:
        for x in (("a", a), ("b", b)):
            if x[1] is not None:
                parent[find(("id", i))] = find(x)
    groups = {}
    for i, *_ in rows:
        groups.setdefault(find(("id", i)), []).append(i)
    return {i: (min(g), len(g)) for g in groups.values() for i in g}


def test_sizes_are_as_near_as_any_choice():
    rng = random.Random(3)
    for _ in range(300):
        groups = [rng.randrange(1, 30) for _ in range(rng.randrange(0, 11))]
        histogram = {n: groups.count(n) for n in groups}
        target = rng.randrange(0, sum(groups) + 1)
        taken = S.nearest_sizes(histogram, target)
        assert all(0 < n <= histogram[size] for size, n in taken.items())
        best = min(abs(sum(some) - target) for k in range(len(groups) + 1) for some in itertools.combinations(groups, k))
        assert abs(sum(size * n for size, n in taken.items()) - target) == best


def test_sizes_beyond_the_exact_search():
    rng = random.Random(4)
    for _ in range(50):
        histogram = {rng.randrange(1, 400): rng.randrange(1, 60) for _ in range(12)} | {1: 50}
        target = sum(size * n for size, n in histogram.items()) // 5
        taken = S.nearest_sizes(histogram, target, exact=1000)
        assert all(n <= histogram[size] for size, n in taken.items())
        assert sum(size * n for size, n in taken.items()) == target


@pytest.mark.parametrize("share", [0.0, 0.2, 0.35, 1.0])
def test_no_value_on_both_sides_and_nearest_size(spark, share):
    rows = random_rows(9, 150, 120)
    parted = S.grouped_split(spark.createDataFrame(rows, SCHEMA), "id", ["a", "b"], share)
    got = {r.id: r.split for r in parted.collect()}
    assert len(got) == 150
    for column in (1, 2):
        for value in {r[column] for r in rows} - {None}:
            assert len({got[r[0]] for r in rows if r[column] == value}) == 1
    sizes = {}
    for least, n in by_search(rows).values():
        sizes[least] = n
    reach = {0}
    for n in sizes.values():
        reach |= {x + n for x in reach}
    n_test = sum(side == "test" for side in got.values())
    assert abs(n_test - round(share * 150)) == min(abs(x - round(share * 150)) for x in reach)
    again = S.grouped_split(spark.createDataFrame(rows, SCHEMA).repartition(5), "id", ["a", "b"], share)
    assert {r.id: r.split for r in again.collect()} == got


def test_empty_table_and_bad_share(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.grouped_split(df, "id", ["a", "b"]).columns == ["id", "a", "b", "group_id", "group_rows", "split"]
    assert S.grouped_split(df, "id", ["a", "b"]).count() == 0
    with pytest.raises(ValueError):
        S.grouped_split(df, "id", [F.col("a")], 1.2)
