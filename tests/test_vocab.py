import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from molspark.catalog import views
from molspark.functions import smiles as S
from molspark.operators import vocab as V
from molspark.operators.splits import assign_batches


@pytest.fixture(scope="module")
def words(spark):
    rng = random.Random(3)
    names = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(len(names))]
    rows = [(i, " ".join(rng.choices(names, weights, k=rng.randint(0, 40)))) for i in range(200)]
    rows += [(1000, None), (1001, "")]
    return rows, spark.createDataFrame(rows, "id bigint, text string")


def tokens():
    return S.word_tokens(F.col("text"))


def expected_vocab(rows):
    counts = Counter(t for _, text in rows for t in (text or "").split())
    order = sorted(counts, key=lambda t: (-counts[t], t))
    return {t: (counts[t], i + V.FIRST_ID) for i, t in enumerate(order)}


def test_vocabulary_order(words):
    rows, df = words
    found = {r.token: (r.n, r.id) for r in V.build_vocabulary(df, tokens()).collect()}
    assert found == expected_vocab(rows)


@pytest.mark.parametrize(("max_tokens", "literal"), [(1, 0), (10, 0), (50_000, 0), (50_000, 256)])
def test_encode_is_the_same_whatever_fits_in_memory(words, max_tokens, literal, monkeypatch):
    monkeypatch.setattr(V, "LITERAL_TOKENS", literal)
    rows, df = words
    ids = expected_vocab(rows)
    vocabulary = V.build_vocabulary(df, tokens())
    encoded = V.encode(df, "id", tokens(), vocabulary, max_tokens=max_tokens, keep=("text",)).collect()
    assert {(r.id, r.text) for r in encoded} == set(rows) and len(encoded) == len(rows)
    by_id = dict(rows)
    for r in encoded:
        assert r.input_ids == [V.CLS] + [ids[t][1] for t in (by_id[r.id] or "").split()]
        assert r.attention_mask == [1] * len(r.input_ids)


@pytest.mark.parametrize(("max_tokens", "literal"), [(2, 0), (50_000, 0), (50_000, 256)])
def test_unknown_tokens(spark, words, max_tokens, literal, monkeypatch):
    monkeypatch.setattr(V, "LITERAL_TOKENS", literal)
    _, df = words
    vocabulary = V.build_vocabulary(df, tokens())
    # "zzz" is unknown and hot: it fills most of the table.
    new = spark.createDataFrame([(1, "zzz waa zzz"), (2, "zzz"), (3, "wab waa")], "id bigint, text string")
    ids = {r.token: r.id for r in vocabulary.collect()}
    found = {r.id: r.input_ids for r in V.encode(new, "id", tokens(), vocabulary, False, max_tokens).collect()}
    assert found == {1: [V.UNK, ids["waa"], V.UNK], 2: [V.UNK], 3: [ids["wab"], ids["waa"]]}


def test_head_is_bounded_by_characters(words):
    _, df = words
    vocabulary = V.build_vocabulary(df, tokens())
    head = V.vocabulary_head(vocabulary, max_characters=10)
    assert len(head.tokens) == 3 and not head.complete
    assert V.vocabulary_head(vocabulary).complete
    with pytest.raises(ValueError):
        V.decode(F.col("input_ids"), head)


@pytest.mark.parametrize("max_tokens", [1, 2, 50_000])
def test_ids_of_the_table_repeated_keys_and_null_keys(spark, max_tokens):
    rows = [(1, "a b c"), (1, "c b a"), (None, "b"), (2, "zzz a"), (None, None)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    vocabulary = spark.createDataFrame([("a", 9, 10), ("b", 8, 20), ("c", 7, 30)], "token string, n bigint, id int")
    encoded = V.encode(df, "id", tokens(), vocabulary, False, max_tokens, keep=("text",)).cache()
    ids = {"a": 10, "b": 20, "c": 30}
    expected = sorted(((i, t, [ids.get(w, V.UNK) for w in (t or "").split()]) for i, t in rows), key=str)
    assert sorted(((r.id, r.text, r.input_ids) for r in encoded.collect()), key=str) == expected
    back = V.decode_rows(encoded, vocabulary, max_tokens=max_tokens).collect()
    assert sorted(((r.id, r.text, r.tokens) for r in back), key=str) == sorted(
        ((i, t, [w for w in (t or "").split() if w in ids]) for i, t in rows), key=str
    )


@pytest.mark.parametrize("max_tokens", [1, 7, 50_000])
def test_decode_rows_undoes_encode(words, max_tokens):
    rows, df = words
    vocabulary = V.build_vocabulary(df, tokens())
    encoded = V.encode(df, "id", tokens(), vocabulary)
    found = {r.id: r.tokens for r in V.decode_rows(encoded, vocabulary, max_tokens=max_tokens).collect()}
    assert found == {i: (t or "").split() for i, t in rows}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    vocabulary = V.build_vocabulary(df, tokens())
    assert vocabulary.count() == 0
    assert V.encode(df, "id", tokens(), vocabulary).count() == 0


@pytest.mark.parametrize("literal", [0, 256])
def test_encode_decode_is_the_identity(spark, literal, monkeypatch):
    monkeypatch.setattr(V, "LITERAL_TOKENS", literal)
    texts = ["C[C@@H](N)C(=O)[O-]", "", "[Na+].[Cl-]", "C%12CCCCC%12"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, smiles string")
    split = S.smiles_tokens(F.col("smiles"))
    vocabulary = V.build_vocabulary(df, split)
    encoded = V.encode(df, "id", split, vocabulary)
    back = V.decode(F.col("input_ids"), V.vocabulary_head(vocabulary))
    rows = encoded.select("id", F.array_join(back, "").alias("s")).collect()
    assert {r.id: r.s for r in rows} == dict(enumerate(texts))


def test_fixed_padding_keeps_long_rows_whole(spark):
    df = spark.createDataFrame([(1, [2, 5], [1, 1]), (2, list(range(600)), [1] * 600)],
                               "id int, input_ids array<int>, attention_mask array<int>")
    rows = {r.id: r for r in V.pad_fixed(df, 512).collect()}
    assert rows[1].input_ids == [2, 5] + [V.PAD] * 510
    assert rows[1].attention_mask == [1, 1] + [0] * 510
    assert not rows[1].overflow
    assert rows[2].overflow and rows[2].input_ids == list(range(600)) and rows[2].n_tokens == 600


def test_batch_padding(spark):
    df = spark.range(100).select(
        "id", F.array_repeat(F.lit(7), (F.col("id") % 11 + 1).cast("int")).alias("input_ids")
    ).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    padded = V.pad_batches(assign_batches(df, "id", 16)).collect()
    widths = {}
    for r in padded:
        widths.setdefault(r.batch_id, []).append(r.n_tokens)
        assert len(r.input_ids) == len(r.attention_mask) == r.width
        assert sum(r.attention_mask) == r.n_tokens
    assert all(r.width == max(widths[r.batch_id]) for r in padded)
    waste = {r.batch_id: r.waste for r in V.padding_waste(V.pad_batches(assign_batches(df, "id", 16))).collect()}
    for batch, sizes in widths.items():
        assert waste[batch] == pytest.approx(1 - sum(sizes) / (max(sizes) * len(sizes)))


def test_open_positions_are_decoded_in_place(spark, words):
    rows, df = words
    vocabulary = V.build_vocabulary(df, tokens())
    texts = {r.id: r.token for r in vocabulary.collect()}
    lists = [(1, [2, 3, 60, 61, 9999, 60]), (2, []), (3, None), (4, [3, 4]), (5, [9999])]
    ids = spark.createDataFrame(lists, "id long, input_ids array<int>").withColumn("tokens", F.lit("replaced"))
    for most in (1, 5, 50_000):
        decoded = V.decode_rows(ids, vocabulary, max_tokens=most)
        assert decoded.columns == ["id", "input_ids", "tokens"]
        got = {r.id: r.tokens for r in decoded.collect()}
        assert got == {i: [texts.get(x) for x in some or [] if x >= V.FIRST_ID] for i, some in lists}


def test_lookups_hold_no_python_strings():
    ids = [pa.array([[7] * 50_000] * 20, pa.list_(pa.int32()))]
    head = V.VocabularyHead(("a",), (3,), False)
    looked = V._look_up_head(head).func(*ids)
    words = pa.array([["word"] * 50_000] * 20, pa.list_(pa.string()))
    tracemalloc.start()
    filled = V._fill_tokens(looked.field("_tokens"), looked.field("_pos"), words)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert filled.to_pylist() == words.to_pylist()
    assert most < 40 * 1_000_000


def test_documents_of_one_file_piece_are_dealt_to_tasks(spark, scratch):
    folder = scratch("one-piece-documents")
    spark.range(9000).selectExpr("id doc_id", "'a text' text").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    sizes = [r["count"] for r in views.documents(spark, folder).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 9 and sum(sizes) == 9000 and max(sizes) < 1200
