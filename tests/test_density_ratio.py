import hashlib
import math

import pytest
from molspark.operators import density_ratio as D
from pyspark.sql import functions as F

SPACE = (D.Dimension("x", 0.0, 2.0), D.Dimension("rate", 1e-4, 1.0, log=True), D.Dimension("k", 1, 4, whole=True), D.Dimension("o", options=("a", "b")))
SCHEMA = "study string, trial_id long, x double, rate double, k int, o string, value double"


def uniform(*key):
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:13], 16) / 2**52


def bin_of(d, value):
    if value is None:
        return None
    if d.options:
        return d.options.index(value) if value in d.options else None
    if d.whole:
        return min(max(value - int(d.low), 0), d.bins - 1)
    share = math.log(value / d.low) / math.log(d.high / d.low) if d.log else (value - d.low) / (d.high - d.low)
    return min(max(math.floor(share * d.bins), 0), d.bins - 1)


def twin(rows, share, n_next, n_candidates, seed):
    out = []
    for study in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == study]
        done = sorted((r for r in own if r[6] is not None and r[6] == r[6]), key=lambda r: (r[6], r[1]))
        cut, last = math.ceil(share * len(done)), max(r[1] for r in own)
        sums = {}
        for i, d in enumerate(SPACE):
            sums[d.name] = [[1] * d.bins, [1] * d.bins]
            for place, row in enumerate(done):
                at = bin_of(d, row[2 + i])
                for b in range(d.bins) if at is not None else ():
                    sums[d.name][place >= cut][b] += max(0, d.reach - abs(b - at))
        drawn = []
        for draw in range(n_candidates):
            bins, score = [], 0.0
            for d in SPACE:
                good, other = sums[d.name]
                aim, b = uniform(seed, d.name, study, last, draw) * sum(good), 0
                while sum(good[: b + 1]) <= aim:
                    b += 1
                bins.append(b)
                score += math.log(good[b]) - math.log(other[b])
            drawn.append((-round(score, 9), draw, tuple(bins)))
        out += [(study, last + 1 + place, bins, round(-score, 6)) for place, (score, _, bins) in enumerate(sorted(drawn)[:n_next])]
    return sorted(out)


def trials(n):
    rows = []
    for i in range(n):
        study = "hot" if i % 3 else f"s{i % 7}"
        x, rate = uniform("x", i) * 2, 10 ** (-4 * uniform("r", i))
        value = None if i % 17 == 5 else math.nan if i % 19 == 3 else round((x - 0.5) ** 2 + abs(math.log10(rate) + 2), 1)
        rows.append((study, i, None if i % 23 == 0 else x, rate, 1 + i % 4, "abz"[i % 3], value))
    return [*rows, ("new", 7, 1.0, 0.5, 2, "a", None)]


def test_equals_the_twin(spark):
    rows = trials(400)
    proposed = D.propose(spark.createDataFrame(rows, SCHEMA), space=SPACE, n_next=4, n_candidates=30, seed=5)
    assert proposed.columns == ["study", "trial_id", "x", "rate", "k", "o", "score"]
    got = sorted((r.study, r.trial_id, tuple(bin_of(d, r[d.name]) for d in SPACE), round(r.score, 6)) for r in proposed.collect())
    assert got == twin(rows, 0.25, 4, 30, 5)


def test_same_under_any_partitioning(spark):
    df = spark.createDataFrame(trials(200), SCHEMA)
    one, other = (sorted(map(tuple, D.propose(df.repartition(p), space=SPACE, n_next=2).collect())) for p in (1, 6))
    assert one == other


def test_rounds_find_the_good_region(spark):
    space = (D.Dimension("x", 0.0, 2.0),)
    value = (F.col("x") - 1.5) ** 2
    seen = spark.range(30).select(F.lit("s").alias("study"), "id", (F.col("id") * 2 / 30).alias("x")).withColumn("value", value)
    for _ in range(3):
        proposed = D.propose(seen, trial="id", space=space, n_next=5)
        seen = spark.createDataFrame(D.append_round(seen, proposed).withColumn("value", value).collect())
    new = [r.x for r in seen.collect() if r.id >= 30]
    assert sorted(r.id for r in seen.collect()) == list(range(45))
    assert sum(abs(x - 1.5) for x in new) / len(new) < 0.35


def test_empty_and_null_study(spark):
    assert D.propose(spark.createDataFrame([], SCHEMA), space=SPACE).count() == 0
    rows = [(None, 1, 0.5, 0.1, 1, "a", 1.0), (None, 2, 1.5, 0.1, 1, "b", 2.0)]
    got = D.propose(spark.createDataFrame(rows, SCHEMA), space=SPACE, n_next=2).collect()
    assert sorted((r.study, r.trial_id) for r in got) == [(None, 3), (None, 4)]
    with pytest.raises(ValueError):
        D.propose(spark.createDataFrame(rows, SCHEMA), share=1.5)
