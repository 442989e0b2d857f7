import hashlib
import random

import numpy as np
import pytest
from helpers import no_docs, odd_docs
from molspark.llm import fingerprint as fp


def jaccard(a, b):
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / max(1, len(x | y))


def expected(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (doc_id, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.fingerprint(text.encode()), fp.fingerprint(edited.encode())))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r)[:5] for r in df.collect()], key=str)


@pytest.mark.parametrize("per_range", [1, 3, 1000])
def test_neighbours_equal_brute_force(spark, per_range):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert got(fp.neighbour_fingerprints(docs.repartition(3), per_range)) == expected(rows)


def test_lone_row_and_empty_table(spark):
    one = spark.createDataFrame([(5, "ab cd")], "doc_id long, text string")
    assert got(fp.neighbour_fingerprints(one)) == expected([(5, "ab cd")])
    assert fp.neighbour_fingerprints(no_docs(spark)).count() == 0


def test_likeness_estimates_jaccard():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    for n, keep in ((40, 20), (400, 100), (2000, 1500), (2000, 0)):
        a, b = words[:n], words[:keep] + words[n : 2 * n - keep]
        a, b = " ".join(a), " ".join(b)
        assert abs(fp.likeness(fp.fingerprint(a.encode()), fp.fingerprint(b.encode())) - jaccard(a, b)) < 0.12


def test_small_sets():
    one, other = fp.fingerprint(b"one"), fp.fingerprint(b"other")
    assert fp.likeness(one, one) == 1.0
    assert fp.likeness(one, other) < 0.1
    assert fp.fingerprint(b" \n") == fp.fingerprint(b"") == ""
    assert (fp.likeness("", ""), fp.likeness("", one)) == (1.0, 0.0)
    assert fp.fingerprint(b"A  b\nC") == fp.fingerprint(b"a b c")


def test_densified_bins_come_from_filled_ones():
    hashes = np.random.default_rng(1).integers(0, 2**64 - 1, 30, dtype=np.uint64)
    bins = fp.bins_of(hashes)
    assert set(bins.tolist()) <= {int(h) & ((1 << 55) - 1) for h in hashes}
    assert len(bins) == fp.BINS


def test_column(spark):
    docs = odd_docs(spark).withColumnRenamed("row", "fingerprint")
    rows = fp.fingerprints(docs).collect()
    assert all(r["fingerprint"] == fp.fingerprint((r["text"] or "").encode()) for r in rows)
