import numpy as np
import pytest
from helpers import no_docs, odd_docs
from molspark.llm import mixing, queries
from pyspark.sql import functions as F

GOOD, BAD = "alpha beta gamma delta epsilon zeta eta theta", "spam casino winner lottery jackpot bonus bets free"


def corpus(spark):
    rows, labels = [], []
    for i in range(400):
        words = (BAD if i % 4 == 0 else GOOD).split()
        rows.append((i, " ".join(words[(i * 7 + k * k) % 8] for k in range(30)) + f" number{i}"))
        if i % 2 == 0:
            labels.append((i, "bad" if i % 4 == 0 else "good"))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")


def test_classes_and_totals(spark):
    docs, labels = corpus(spark)
    for targets in ({"good": 0.9, "bad": 0.1}, {"good": 0.5, "bad": 0.5}, {"good": 1.0, "bad": 0.0}):
        rows = mixing.mixed(docs, labels, targets).collect()
        assert sum((r["domain"] == "bad") == (r["doc_id"] % 4 == 0) for r in rows) >= 396
        assert all(r["rate"] >= 0 for r in rows)
        total = sum(r["rate"] * r["n_tokens"] for r in rows)
        share = sum(r["rate"] * r["n_tokens"] for r in rows if r["domain"] == "bad") / total
        assert abs(share - targets["bad"]) < 0.03
        assert all(r["copies"] >= 1 for r in rows if r["domain"] == "good" and r["rate"] >= 1)
        assert np.mean([r["rate"] for r in rows if r["domain"] == "good"]) >= 0.99


def problem(seed, sharp=1.0, rows=3000):
    r = np.random.default_rng(seed)
    kind = r.choice(3, rows, p=[0.6, 0.37, 0.03])
    logits = np.log([0.6, 0.37, 0.03]) + r.normal(0, 1, (rows, 3)) + 2 * sharp * np.eye(3)[kind]
    p = np.rint(mixing.PARTS * np.exp(logits) / np.exp(logits).sum(1, keepdims=True)) / mixing.PARTS
    return p, r.integers(50, 500, rows).astype(float)


def by_newton(p, n, own, target, least):
    """The residuals y that the rates max(least, 1 - p y / PULL) leave: the minimum of a convex function
    of one variable per domain, by damped Newton steps."""
    y = np.zeros(len(own))

    def slope_of(y):
        rates = np.maximum(least, 1 - p @ y / mixing.PULL)
        return own * y + target - (n * rates) @ p, rates > least

    for _ in range(500):
        slope, free = slope_of(y)
        bend = np.diag(own) + (p[free] * n[free, None]).T @ p[free] / mixing.PULL
        step, length = np.linalg.solve(bend, -slope), 1.0
        while length > 1e-9 and np.abs(slope_of(y + length * step)[0] / own).max() > np.abs(slope / own).max():
            length /= 2
        y = y + length * step
        if np.abs(step).max() < 1e-12:
            break
    return y


@pytest.mark.parametrize("keep", [False, True])
@pytest.mark.parametrize("sharp", [0.5, 1.0, 2.0])
def test_gradient_steps_end_at_the_least_squares_solution(spark, sharp, keep):
    p, n = problem(7, sharp)
    scored = spark.createDataFrame([(int(t), [float(v) for v in row]) for t, row in zip(n, p, strict=True)], "n_tokens long, posteriors array<double>")
    mix = mixing.fit_rates(scored.repartition(3), None, {"good": 0.88, "low": 0.12, "toxic": 0.0}, keep)
    assert mix.change <= mixing.ENOUGH
    own, share = n @ p, np.array([0.88, 0.12, 0.0])
    target = share * mixing.MARGIN * (own[:2] / share[:2]).max()
    least = mixing.least_rates(p, mix.kept)
    exact = np.maximum(least, 1 - p @ by_newton(p, n, own, target, least) / mixing.PULL)
    rates = mix.rates(p)
    assert np.abs(rates - exact).max() < 1e-3

    def cost(w):
        miss = (n * w) @ p - target
        return (miss**2 / own).sum() / 2 + mixing.PULL * (n * (w - 1) ** 2).sum() / 2

    r, best = np.random.default_rng(1), cost(rates)
    for _ in range(200):
        other = np.maximum(least, rates + r.normal(0, 0.01, len(rates)))
        assert cost(other) >= best - 1e-6 * abs(best)
    assert (rates[least == 1] >= 1).all() and (least == 1).any() == keep


def test_query_equals_brute_force(spark):
    """The whole output of the query, from the classifier's posteriors on, in plain numpy."""
    sf = "/root/testdata/sf0.01"
    got = queries.all_queries()["op7_mix_sources"](spark, sf).orderBy("doc_id").toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    marks = mixing.quality_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    domains = list(mixing.TARGETS)
    classifier = mixing.fit_classifier(docs, marks, domains)
    texts = [(r.text or "").encode() for r in docs.collect()]
    p, n = np.array([classifier.posterior(t) for t in texts]), np.array([len(t.split()) for t in texts], float)
    own, share = n @ p, np.array([mixing.TARGETS[d] for d in domains])
    target = share * mixing.MARGIN * (own[share > 0] / share[share > 0]).max()
    exact = np.maximum(0, 1 - p @ by_newton(p, n, own, target, np.zeros(len(p))) / mixing.PULL)
    assert (got.n_tokens == n).all() and (got.domain == np.array(domains)[p.argmax(1)]).all()
    assert np.abs(got.posterior - p.max(1)).max() == 0 and np.abs(got.rate - exact).max() < 1e-3
    assert ((got.copies >= np.floor(got.rate)) & (got.copies <= np.ceil(got.rate))).all()
    tokens = (n * got.rate.to_numpy()) @ p
    assert np.abs(tokens / tokens.sum() - share).max() < 0.01


def test_words_are_hashed_alike_however_they_are_remembered():
    text = "Some, words. some WORDS! again: a-b c_d 12".encode()
    marks = {m for w in set(text.lower().split()) for m in mixing._marks(w)}
    assert marks < set(mixing.features(text).tolist()) and len(mixing.features(text)) == len(marks) + 2
    assert set(mixing.features(text)) == set(mixing.features(b" ".join(reversed(text.split()))))


def test_odd_rows_and_missing_labels(spark):
    docs = odd_docs(spark).withColumnRenamed("row", "rate")
    labels = spark.createDataFrame([(1, "good"), (1, "bad"), (None, "bad"), (77, "good"), (4, "other"), (6, None)], "doc_id long, domain string")
    targets = {"good": 0.7, "bad": 0.3}
    for told in (labels, labels.limit(0)):
        rows = mixing.mixed(docs, told, targets).collect()
        assert len(rows) == docs.count()
        assert all(np.isfinite(r["rate"]) and r["copies"] >= 0 for r in rows)
        assert mixing.repeated(docs, told, targets).columns == docs.columns
    empty = no_docs(spark)
    assert mixing.mixed(empty, labels, {"good": 1.0}).count() == 0
    with pytest.raises(ValueError, match="targets"):
        mixing.mixed(docs, labels, {"good": 0.0})


def test_repeated_has_the_copies(spark):
    docs, labels = corpus(spark)
    targets = {"good": 0.5, "bad": 0.5}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(docs, labels, targets).collect()}
    out = {r["doc_id"]: r["count"] for r in mixing.repeated(docs, labels, targets, keep=False).groupBy("doc_id").agg(F.count("*").alias("count")).collect()}
    assert out == {k: v for k, v in copies.items() if v}
    kept = mixing.repeated(docs, labels, targets).select("doc_id").distinct().count()
    assert kept == docs.count()


def test_a_word_of_many_texts_is_hashed_once(monkeypatch):
    """More distinct words than a task used to remember, in several texts: rows as ``features`` has them."""
    r = np.random.default_rng(3)
    slot = np.full(mixing.BUCKETS, -1, np.int64)
    slot[r.choice(mixing.BUCKETS, mixing.CHOSEN, replace=False)] = np.arange(mixing.CHOSEN)
    model = mixing.Classifier(["a", "b", "c"], np.zeros(3), slot, r.normal(0, 0.1, (mixing.CHOSEN, 3)))
    words = [b"w%d" % i if i % 3 else b"w%d-x.%d" % (i, i) for i in range(70_000)]
    texts = [b" ".join(words), b" ".join(words[::-1]), b"", b"A\x1cB \t\n -- \xc3\xa9\x00", b" ".join(words[::2])]
    expected = []
    for text in texts:
        rows = slot[mixing.features(text)]
        logs = model.weights[np.sort(rows[rows >= 0])].sum(0)
        shares = np.exp(logs - logs.max())
        expected.append((len(text.split()), np.rint(mixing.PARTS * shares / shares.sum()) / mixing.PARTS))
    digest, hashed = mixing.xxhash.xxh3_64_intdigest, []
    monkeypatch.setattr(mixing.xxhash, "xxh3_64_intdigest", lambda word: hashed.append(word) or digest(word))
    got = model.read(texts)
    assert [n for n, _ in got] == [n for n, _ in expected]
    assert all((p == q).all() for (_, p), (_, q) in zip(got, expected, strict=True))
    assert len(hashed) < 2.5 * len(words)
