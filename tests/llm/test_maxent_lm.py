import collections
import math
import zlib

import numpy as np
import pytest
from helpers import no_docs, odd_docs
from molspark.llm import maxent_lm as lm
from molspark.llm import word_tree
from molspark.llm.common import crc_bucket, read_table
from pyspark.sql import functions as F


def run(docs):
    model, counts = lm.fit(docs.where(crc_bucket("doc_id", 7) != 2))
    held_out = F.coalesce(crc_bucket("doc_id", 7) == 2, F.lit(False))
    return model, lm.score(docs.withColumn("held_out", held_out), model, counts).collect()


def tokens(text):
    return [*(text or "").encode().lower().split(), "end"]


def check_base(docs, rows):
    counts = collections.Counter()
    for r in docs:
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            counts.update(tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    truth = collections.Counter()
    for r in docs:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2
        t = tokens(r["text"])
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        truth[str((r["doc_id"], held, len(t), sum(counts[w] > 0 for w in t), n, round(base, 5)))] += 1
    got = collections.Counter(
        str((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5))) for r in rows
    )
    assert got == truth


def test_base_scores_equal_brute_force_and_the_model_beats_them(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", 500)  # most words take the joined way
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    _, rows = run(docs)
    check_base(docs.collect(), rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumnRenamed("row", "n_tokens")
    _, rows = run(docs)
    check_base(docs.collect(), rows)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)


def test_empty_tables(spark):
    model, counts = lm.fit(no_docs(spark))
    assert lm.score(no_docs(spark).withColumn("held_out", F.lit(True)), model, counts).count() == 0
    rows = lm.score(odd_docs(spark).withColumn("held_out", F.lit(True)), model, counts).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in rows} == {(0, 0, 0.0)}


@pytest.fixture(scope="module")
def model():
    r = np.random.default_rng(3)
    words = [f"w{i}".encode() for i in range(400)]
    made = lm.Model.start(words, np.arange(400, 0, -1), 400 * 401 // 2, 400)
    made.classes += r.normal(0, 1, made.classes.shape).astype(np.float32)
    made.slots += r.normal(0, 1, made.slots.shape).astype(np.float32)
    return made


def test_probabilities_add_up(model):
    """All output words, all rarer known words and one unknown event share one."""
    reader = lm.Reader(model)
    total = 0.0
    for i in range(len(model.words)):
        _, ranks, _, _, features = reader.read([b"w1 w7 " + model.words[i]])
        classes, slots, cls, output = reader.log_shares(ranks, features)
        at = 2
        share = math.exp(classes[at, cls[at]])
        if i < lm.OUTPUTS:
            share *= math.exp(slots[list(output).index(at), ranks[at] % lm.SLOTS])
        else:
            share *= (model.counts[i] + 1) / model.rare_mass
        total += share
    rare = math.exp(classes[at, lm.CLASSES])
    assert abs(total + rare / model.rare_mass - 1) < 1e-4


def test_gradient_equals_finite_differences(model):
    texts = [b"w1 w2 w3 w300 w1 w2", b"w9 w9 unknown w1", None]
    reader, sums = lm.Reader(model), lm._Sums()
    sums.add(reader, texts)

    def likelihood():
        _, ranks, _, _, features = reader.read(texts)
        classes, slots, cls, output = reader.log_shares(ranks, features)
        return classes[np.arange(len(cls)), cls].astype(float).sum() + slots[np.arange(len(output)), ranks[output] % lm.SLOTS].astype(float).sum()

    _, _, _, _, features = reader.read(texts)
    for f, c in ((features[0][1], 0), (features[2][2], lm.CLASSES), (lm.FEATURES - 1, 0)):
        old = model.classes[f, c]
        model.classes[f, c] = old + 0.05
        up = likelihood()
        model.classes[f, c] = old - 0.05
        down = likelihood()
        model.classes[f, c] = old
        assert abs((up - down) / 0.1 - sums.gradient[0][f, c]) < 0.02


def test_sums_by_row_of_all_rows():
    r = np.random.default_rng(4)
    rows = r.integers(0, lm.FEATURES * lm.CLASSES, 5000)
    rows[:2] = 0, lm.FEATURES * lm.CLASSES - 1  # the least and the largest row of either kind
    values = r.normal(size=(5000, 3)).astype(np.float32)
    at, sums = lm._by_row(rows, values)
    truth = np.zeros((lm.FEATURES * lm.CLASSES, 3))
    np.add.at(truth, rows, values)
    assert list(at) == sorted(set(rows.tolist()))
    assert np.allclose(sums, truth[at], atol=1e-5)


def paired(n=400, pairs=150):
    """Each first word has a second one of its own; all are beyond the outputs, and equally frequent."""
    r = np.random.default_rng(5)
    common = [f"c{i}" for i in range(lm.OUTPUTS)] * 2 * n
    texts = [" ".join(common)] + [" ".join(f"a{i} b{i}" for i in r.permutation(pairs)) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("head", [200_000, lm.OUTPUTS])
def test_context_tells_words_beyond_the_outputs_apart(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)  # the least one leaves all pairs to the joined way
    model, counts = lm.fit(spark.createDataFrame(paired(), "doc_id long, text string"))
    asked = [(0, "a3 b3 a7 b7 a90 b90"), (1, "a3 b7 a7 b90 a90 b3")]
    rows = lm.score(spark.createDataFrame(asked, "doc_id long, text string").withColumn("held_out", F.lit(True)), model, counts).collect()
    own, other = sorted(rows, key=lambda row: row["doc_id"])
    assert own["n_known"] == own["n_tokens"] == other["n_known"]
    assert abs(own["base_score"] - other["base_score"]) < 1e-9
    # with unigram shares within the class of all other words, no score is larger than this
    most = 6 * math.log10(401 / model.rare_mass) + math.log10(402 / model.rare_mass)
    assert own["score"] > most + 3 and own["score"] > other["score"] + 3


def test_shares_of_all_words_and_one_unknown_add_up(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", 500)
    monkeypatch.setattr(word_tree, "BUCKET_BITS", 8)
    r = np.random.default_rng(6)
    texts = [" ".join(f"w{int(w)}" for w in r.zipf(1.2, 300) if w < 3000) for _ in range(60)]
    model, counts = lm.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert len(model.words) < model.distinct - 300 and len(model.tree.held) == 1
    assert model.tree.learned
    model.tree.weights[:] = r.normal(0, 1, model.tree.weights.shape)
    words = [w.decode() for w in {w for t in texts for w in lm.tokens_of(t.encode())} if w != lm.END]
    asked = [(i, f"w1 w2 {w}") for i, w in enumerate([*words, "unknown"])] + [(-1, "w1 w2")]
    rows = lm.score(spark.createDataFrame(asked, "doc_id long, text string").withColumn("held_out", F.lit(True)), model, counts).collect()
    # shares of the third token: what follows it, the end, is taken off
    reader, total = lm.Reader(model), 0.0
    score = {row["doc_id"]: row["score"] for row in rows}
    total += 10 ** (score[-1] - sum(of_tokens(reader, "w1 w2", 2)))
    for i, text in asked[:-1]:
        first = of_tokens(reader, text, 2)
        total += 10 ** (score[i] - sum(first) - of_tokens(reader, text, 4)[-1])
    assert abs(total - 1) < 1e-3


def of_tokens(reader, text, n):
    """Logs of the shares of the first ``n`` tokens, which are words of the head."""
    _, ranks, _, _, features, contexts, hashes = reader.read_all([text.encode()])
    classes, slots, cls, output = reader.log_shares(ranks, features)
    logs = classes[np.arange(len(cls)), cls].astype(float)
    logs[output] += slots[np.arange(len(output)), ranks[output] % lm.SLOTS]
    shared, leaf = reader.leaves(ranks, hashes)
    logs[shared] += reader.model.tree.logs(leaf, hashes[shared], contexts[:, shared])
    return (logs[:n] / np.log(10)).tolist()


def test_tree_gradient_equals_finite_differences(model):
    r = np.random.default_rng(7)
    hashes = r.integers(0, 1 << 63, 50).astype(np.uint64)
    leaves = np.zeros(1 << 22, bool)
    leaves[hashes >> np.uint64(42)] = True
    rest = word_tree.Unnamed(leaves.reshape(1 << 16, -1).sum(1) * 3.0, np.packbits(leaves, bitorder="little"))
    tree = word_tree.WordTree.start(model.counts[lm.OUTPUTS :] + 1.0, rest, 4000)
    assert tree.leaf_bits == 22
    tree = tree.moved(r.normal(0, 1, tree.weights.shape).astype(np.float32))
    leaf = tree.leaves(np.where(np.arange(50) < 25, np.arange(50), -1), hashes)
    assert (leaf >= 0).all()
    contexts = r.integers(0, 1 << 32, (3, 50)).astype(np.uint32)
    sums = np.zeros((2, *tree.weights.shape), np.float32)
    tree.add(leaf, hashes, contexts, *sums)
    for row in np.flatnonzero(sums[0].sum(1))[:10]:
        for part in range(word_tree.WAYS):
            old = tree.weights[row, part]
            tree.weights[row, part] = old + 0.05
            up = tree.logs(leaf, hashes, contexts).sum()
            tree.weights[row, part] = old - 0.05
            down = tree.logs(leaf, hashes, contexts).sum()
            tree.weights[row, part] = old
            assert abs((up - down) / 0.1 - (sums[0] - sums[1])[row, part]) < 0.02


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 9, 15, 16, 200])
def test_tree_starts_from_the_shares_of_its_words(n):
    masses = np.random.default_rng(n).integers(1, 1000, n).astype(float)
    tree = word_tree.WordTree.start(masses, word_tree.Unnamed.none(), 10)
    shares = np.exp(tree.logs(np.arange(n, dtype=np.int32), np.zeros(n, np.uint64), np.zeros((3, n), np.uint32)))
    assert np.allclose(shares, masses / masses.sum() if n else [], rtol=1e-4)
