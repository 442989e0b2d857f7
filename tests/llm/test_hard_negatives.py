"""Mined negatives against all pairs, and the parts that leave blocks out against plain counterparts."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from molspark.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score double, rank int"


def expected(rows, positives=5, negatives=5, percent=80):
    """Rows (vec_id, ints, label); every row against every row."""
    out = []
    for i, (a, va, la) in enumerate(rows):
        if a % 100:
            continue
        def score(v, va=va):
            return sum(x * y for x, y in zip(va, v))
        others = [(-score(v), b, lb) for j, (b, v, lb) in enumerate(rows) if j != i]
        for s, p, _ in sorted((s, b) + (0,) for s, b, lb in others if lb == la)[:positives]:
            window = sorted((n, b) for n, b, lb in others if lb != la and percent * -s <= 100 * -n <= 100 * -s)
            out += [(a, p, rank + 1, b, -s, -n) for rank, (n, b) in enumerate(window[:negatives])]
    return sorted(out)


def mined(spark, data, **more):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    df = df.select("*", hn.quantised("embedding").alias("vector"))
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % 100 == 0, **more).collect())


def quantise(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def table(rng, n, dims=6, labels=4, ids=None):
    return [((ids or range(n))[i], [rng.gauss(0, 1) for _ in range(dims)], rng.randrange(labels), "clash", 0.5, 1) for i in range(n)]


@pytest.mark.parametrize("n, dims, labels", [(1500, 6, 4), (900, 64, 3), (40, 3, 40), (700, 1, 2)])
def test_equals_all_pairs(spark, n, dims, labels):
    data = table(random.Random(n), n, dims, labels)
    assert mined(spark, data) == expected([(i, quantise(v), label) for i, v, label, *_ in data])


def test_other_limits(spark):
    data = table(random.Random(3), 800)
    rows = [(i, quantise(v), label) for i, v, label, *_ in data]
    assert mined(spark, data, positives=2, negatives=3, percent=50) == expected(rows, 2, 3, 50)


def test_one_vector_in_a_third_of_all_rows_and_ties(spark):
    rng = random.Random(4)
    data = table(rng, 2000, 4, 3)
    data = [(i, [0.5, 0.25, 0.0, 0.1] if i % 3 == 0 else [float(round(x)) for x in v], 0 if i % 3 == 0 and i % 2 else label, *rest) for i, v, label, *rest in data]
    assert mined(spark, data) == expected([(i, quantise(v), label) for i, v, label, *_ in data])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = table(random.Random(8), 300)
    odd = [(300, None, 1), (400, [1.0, nan, 0.0, 0.0, 0.0, 0.0], 1), (500, [inf] * 6, 1), (600, [None] * 6, 2), (700, [0.1] * 6, None), (None, [0.1] * 6, 1)]
    short = [(800, [1.0, 1.0], 1), (801, [], 1), (802, [2.0], 0)]
    data = good + [(*row, "clash", 0.0, 1) for row in odd + short]
    rows = [(i, quantise(v), label) for i, v, label, *_ in good] + [(i, quantise(v) + [0] * (6 - len(v)), label) for i, v, label in short]
    assert mined(spark, data) == expected(rows)


def test_repeated_rows_count_each(spark):
    data = table(random.Random(9), 120) * 2
    assert mined(spark, data) == expected([(i, quantise(v), label) for i, v, label, *_ in data])


def test_numbers_beyond_exact_doubles(spark):
    rng = random.Random(10)
    data = [(i, [rng.choice([-1, 1]) * rng.randrange(1, 1 << 19) * 1.0 for _ in range(3)], i % 2, "", 0.0, 1) for i in range(220)]
    assert mined(spark, data) == expected([(i, quantise(v), label) for i, v, label, *_ in data])


def test_nothing_to_mine(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(7, [1.0], 1, "", 0.0, 1)]) == []
    assert mined(spark, [(100, [1.0], 1, "", 0.0, 1), (101, [], 1, "", 0.0, 1), (102, [], 2, "", 0.0, 1)]) == [(100, 101, 1, 102, 0, 0)]


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_passes_every_cell_in_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in hn.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_leave_blocks_out(spark):
    rng = np.random.default_rng(1)
    boxes = [np.sort(rng.integers(-50, 50, (2, 5)), axis=0) for _ in range(20)]
    anchors = rng.integers(-50, 50, (10, 5))
    under, over = hn._bounds(anchors, np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes]))
    for j, (lo, hi) in enumerate(boxes):
        corners = np.array(list(itertools.product(*zip(lo, hi))))
        scores = anchors @ corners.T
        assert (scores.min(axis=1) == under[:, j]).all() and (scores.max(axis=1) == over[:, j]).all()
    # tight clusters: most blocks need not be read
    centres = rng.normal(size=(12, 8)) * 4
    data = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=8) * 0.01], int(i % 12) // 2) for i in range(24000)]
    rows = spark.createDataFrame(data, "id long, e array<double>, label long")
    rows = rows.select("id", "label", (F.col("id") % 100 == 0).alias("anchor"), hn.quantised("e").alias("vector"))
    least, most = rows.agg(F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    blocks = hn.Blocks(rows, hn.Shape(8, least, most), 5)
    anchors = blocks.anchors().withColumn("highs", F.array("floor"))
    packs = anchors.select("at", "label", "vector", "highs").repartitionByRange(1, "at").mapInArrow(hn._pack, hn._PACK)
    zone = F.struct("block", "label_least", "label_most", "least", "most")
    zones = blocks.table.agg(F.collect_list(zone).alias("zones"))
    asked = packs.join(zones).mapInArrow(hn._choose(blocks.shape, None), f"block long, {hn._PACK}")
    read = asked.select(F.sum(F.length("ats") / 8)).first()[0]
    assert read < 0.5 * anchors.count() * blocks.table.count()
