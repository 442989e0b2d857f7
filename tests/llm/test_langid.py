import collections
import itertools
import math

import numpy as np
import public_tokenizers
from helpers import no_docs, odd_docs
from molspark.llm import bpe, langid
from molspark.llm.common import crc_bucket, read_table
from pyspark.sql import functions as F

PIECES = langid.piece_vocabulary(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def small_model():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba"]
    r = np.random.default_rng(0)
    p = r.random((2, len(pieces)))
    return langid.Model(["x", "y"], pieces, np.hstack([p / p.sum(1, keepdims=True), np.zeros((2, 1))]))


def all_segmentations(word, pieces):
    if not word:
        yield []
    for i in range(1, len(word) + 1):
        if word[:i] in pieces:
            for rest in all_segmentations(word[i:], pieces):
                yield [word[:i], *rest]


def test_forward_sums_all_segmentations():
    model = small_model()
    words = [b" " + "".join(w).encode() for n in (1, 3, 6) for w in itertools.product("ab", repeat=n)]
    got = model.log_probabilities(words)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            total = sum(math.prod(model.probabilities[k, model.ids[p]] for p in s) for s in all_segmentations(w, set(model.pieces)))
            assert abs(row[k] - math.log(total)) < 1e-9


def test_expected_uses_equal_enumeration():
    model = small_model()
    word = b" abab"
    uses = model.expected([word], np.array([3]), 1)
    weighted = [(s, math.prod(model.probabilities[1, model.ids[p]] for p in s)) for s in all_segmentations(word, set(model.pieces))]
    total = sum(w for _, w in weighted)
    for p, i in model.ids.items():
        assert abs(uses[i] - 3 * sum(w * s.count(p) for s, w in weighted) / total) < 1e-9


def test_long_words_do_not_underflow():
    model = langid.Model(["x"], PIECES, np.hstack([np.full((1, len(PIECES)), 1 / len(PIECES)), [[0.0]]]))
    assert np.isfinite(model.log_probabilities([b" " + b"q" * 256])).all()


def test_held_out_accuracy(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.fit(docs.where(crc_bucket("doc_id", 4) != 2).select("doc_id", "text", "lang"), PIECES)
    told = langid.predict(docs.where(crc_bucket("doc_id", 4) == 2), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in told) >= 0.95 * len(told) > 20


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumnRenamed("row", "lang_pred")
    model = langid.fit(docs.where("lang is not null").select("doc_id", "text", "lang"), PIECES)
    told = langid.predict(docs, model)
    assert told.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"]
    rows = told.collect()
    assert len(rows) == docs.count()
    for row in rows:
        undetermined = not any(c.isalpha() for c in row["text"] or "")
        assert (row["lang_pred"] == "und") == undetermined
        assert row["score"] == 0.0 if undetermined else 0.0 < row["score"] <= 1.0
    assert langid.predict(no_docs(spark), model).count() == 0


def test_no_labelled_rows(spark):
    model = langid.fit(no_docs(spark).select("doc_id", "text", "lang"), PIECES)
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(odd_docs(spark), model).collect()} == {("und", 0.0)}


def test_languages_of_long_runs_are_learned(spark):
    """Runs of letters without spaces, all of more than 40 bytes."""
    r = np.random.default_rng(4)
    letters = {"x1": "天地玄黄宇宙洪荒日月盈昃", "x2": "寒来暑往秋收冬藏闰余成岁"}
    rows = [(i, "".join(r.choice(list(letters[k]), 20 + 3 * (i % 9))), k) for i, k in enumerate(["x1", "x2"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 40"), PIECES)
    told = langid.predict(docs.where("doc_id >= 40"), model).collect()
    assert [r["lang_pred"] for r in told] == [r["lang"] for r in told]


def test_uses_of_a_long_word_cover_its_bytes():
    model = langid.Model(["x"], PIECES, np.hstack([np.full((1, len(PIECES)), 1 / len(PIECES)), [[0.0]]]))
    for word in (" " + "天地玄黄" * 16, " " + "\U00012000" * 64):
        uses = model.expected([word.encode()], np.array([1]), 0)
        assert abs(sum(uses[i] * len(PIECES[i]) for i in np.flatnonzero(uses)) - len(word.encode())) < 1e-6


def test_fitting_ends_when_it_gains_nothing(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").where("lang is not null").select("doc_id", "text", "lang")
    model = langid.fit(docs, PIECES)
    for k, lang in enumerate(model.languages):
        seen = collections.Counter(w for r in docs.where(F.col("lang") == lang).collect() for w in langid.words(r["text"] or ""))
        found, counts = [langid._spaced(w) for w in seen], np.array(list(seen.values()))
        now = counts @ model.log_probabilities(found)[:, k]
        uses = model.expected(found, counts, k)
        rows = model.probabilities.copy()
        rows[k, :-1] = (1 - langid.FLOOR) * uses / uses.sum() + langid.FLOOR / len(PIECES)
        more = counts @ langid.Model(model.languages, PIECES, rows).log_probabilities(found)[:, k]
        assert more - now <= 1e-3 * abs(more)
