import random

import corpus_pipeline
import numpy as np
import pytest
from helpers import no_docs, odd_docs
from molspark.llm import near_dedup
from molspark.llm.components import components


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text) rows, comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    above = list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                above[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[i]:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = least.get(top(i)) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id is not None and doc_id == component))
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def corpus(seed):
    """Unrelated texts, a passage that many share, small groups and one large group of near copies
    that no single document is similar to all of."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(120):
        own = [word() for _ in range(r.randint(1, 150))]
        texts.append(own + passage if i % 2 else own)
    for size, length, edits in ((5, 120, 2), (12, 90, 2), (200, 150, 3)):
        base = [word() for _ in range(length)]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randint(0, edits)):
                copy[r.randrange(length)] = word()
            texts.append(copy)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(near_dedup.near_duplicates(docs)) == brute(rows)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    assert found(near_dedup.near_duplicates(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert near_dedup.near_duplicates(no_docs(spark)).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {1, 3, 4, 5, 6, 7, 8, 9, 10} <= {r["doc_id"] for r in kept.collect()}
    assert 2 not in {r["doc_id"] for r in kept.collect()}


def test_sketches_estimate_similarity():
    r = np.random.default_rng(0)
    pool = np.unique(r.integers(0, 2**63, 3000).astype(np.uint64))
    a, b = pool[:2000], pool[500:2500]
    share = (near_dedup.sketch(a) == near_dedup.sketch(b)).mean()
    assert abs(share - 1500 / 2500) < 0.25


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(50)]
    links = spark.createDataFrame([*path, *star, (7, 7), (500, 500), (None, 3)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert roots == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(51)}, 500: 500}
    assert components(links.where("a is null")).count() == 0


def test_a_lower_threshold_links_what_the_default_leaves(spark):
    """200 words with four single-word edits far apart: 176 of 216 shingles are shared."""
    rows, r = [], random.Random(5)
    for i in range(40):
        words = [f"w{r.randrange(10**6)}" for _ in range(200)]
        rows.append((2 * i, " ".join(words)))
        for at in (30, 70, 110, 150):
            words[at] = "edited"
        rows.append((2 * i + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x["doc_id"] for x in near_dedup.keep_one(docs).collect()} == set(range(80))
    assert {x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == set(range(0, 80, 2))


def test_the_search_follows_its_threshold():
    at = near_dedup.Search(85)
    assert (at.second, at.trees, at.candidate) == (430, 10, 0.62)
    lower = near_dedup.Search(80)
    assert lower.second > at.second and lower.candidate == 0.55 and 2 * lower.trees <= near_dedup.TOKENS
    with pytest.raises(ValueError, match="threshold"):
        near_dedup.Search(50)


def test_about_one_pair_a_member_is_confirmed(spark, monkeypatch):
    confirm, counted = near_dedup._confirm, []

    def spy(pairs, sets, search):
        counted.append(pairs.count())
        return confirm(pairs, sets, search)

    monkeypatch.setattr(near_dedup, "_confirm", spy)
    per_member = []
    for size in (150, 450):
        r = random.Random(size)
        base = [f"w{r.randrange(10**6)}" for _ in range(150)]
        rows = []
        for i in range(size):
            copy = list(base)
            copy[r.randrange(150)] = f"e{r.randrange(10**6)}"
            rows.append((i, " ".join(copy)))
        counted.clear()
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert found(got) == brute(rows)
        per_member.append(sum(counted) / size)
    assert max(per_member) < 4 and per_member[1] < 1.5 * per_member[0]


def test_rows_that_repeat_an_id_are_kept_by_their_texts(spark):
    r = random.Random(3)
    words = [f"w{r.randrange(10**6)}" for _ in range(120)]
    near = [*words[:-1], "edited"]
    other = " ".join(f"z{r.randrange(10**6)}" for _ in range(50))
    rows = [(1, " ".join(words), 0), (2, " ".join(near), 0), (2, other, 0), (2, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __near_ids int")
    assert {(x.doc_id, x.text) for x in near_dedup.keep_one(docs).collect()} == {(1, " ".join(words)), (2, other), (2, None)}


def test_sizes_and_rows_come_from_one_branching(spark, monkeypatch):
    """Children of large nodes are read twice, for sizes and for rows, but branched once."""
    sized, generates = near_dedup._sized, []

    def spy(rows):
        generates.append("Generate" in rows._jdf.queryExecution().toString())
        return sized(rows)

    monkeypatch.setattr(near_dedup, "_sized", spy)
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(60):
        copy = list(base)
        copy[r.randrange(150)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert found(got) == brute(rows)
    assert len(generates) > 1 and not any(generates[1:])


def test_near_copies_are_not_branched_level_by_level(spark, monkeypatch):
    """Copies of one text that resemble each other, most of them below the threshold: they stand in one
    node of their pivot and not in the children of all trees."""
    written = near_dedup.materialize
    counted = {"near-branches": 0, "near-large": 0}

    def spy(df, label):
        out = written(df, label)
        if label in counted:
            counted[label] += out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialize", spy)
    r = random.Random(11)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(r.choice((1, 3, 3))):
            copy[r.randrange(200)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert found(got) == brute(rows)
    assert counted["near-branches"] < 2 * len(rows)
    assert 0 < counted["near-large"] < 4 * len(rows)


def test_sketches_are_written_with_classes_and_branches_only(spark, monkeypatch):
    """Roots and shares are written again and again; what they hold of a class is a few numbers."""
    written, columns = near_dedup.materialize, {}

    def spy(df, label):
        columns.setdefault(label, set()).update(df.columns)
        return written(df, label)

    monkeypatch.setattr(near_dedup, "materialize", spy)
    rows = corpus(3)
    assert found(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows)
    assert {"near-rooted", "near-told"} <= set(columns)
    assert {label for label, names in columns.items() if "sketch" in names} <= {"near-sketches", "near-classes", "near-above", "near-branches"}


def test_two_rows_of_a_large_node_meet_in_one_block(spark, monkeypatch):
    """Block by block, all rows with those outside the main component, and no two of them twice."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    made = [(1, n, n if n < 30 else 99, 99) for n in range(41)] + [(2, n, 7 if n else 3, 7) for n in range(9)]
    open_rows = spark.createDataFrame(made, "path long, node long, root long, main long")
    sides = {}
    for r in near_dedup._dealt(open_rows).collect():
        sides.setdefault((r.path, r.i, r.j), ([], []))[0 if r.asks else 1].append(r.node)
    met = []
    for (path, i, j), (x, y) in sides.items():
        assert not (i == j and y)
        met += [(path, *sorted((a, b))) for k, a in enumerate(x) for b in (x[k + 1 :] if i == j else y)]
    main = {(path, node): root == main for path, node, root, main in made}
    truth = {(p, a, b) for p, a in main for q, b in main if p == q and a < b and not (main[p, a] and main[p, b])}
    assert len(met) == len(set(met)) and set(met) == truth


def test_blocks_of_a_large_node_link_as_all_its_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r = random.Random(13)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(r.choice((1, 3, 4))):
            copy[r.randrange(200)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert found(got) == brute(rows)
