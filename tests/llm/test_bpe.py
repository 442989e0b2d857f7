import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from helpers import no_docs, odd_docs
from molspark.llm import bpe, queries
from molspark.sources.tables import spread_large
from pyspark.sql import functions as F

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
MERGES = bpe.Merges(RANKS)
TRUTH = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def random_text(r: random.Random, size: int) -> str:
    kind = r.randrange(3)
    if kind == 0:
        return "".join(r.choice("abcdeth ing  \n's'll ré12") for _ in range(size))
    if kind == 1:
        return "".join(chr(r.choice([r.randint(1, 300), r.randint(0x400, 0x500), 0x4E2D, 0x1F600])) for _ in range(size))
    return r.choice("a -=_\n") * size


def test_tokens_equal_the_public_library():
    r = random.Random(1)
    pieces, split = bpe.PieceTokens(MERGES), bpe.Splitter(PATTERN)
    for _ in range(600):
        text = random_text(r, r.randrange(80))
        assert [t for p in split(text) for t in pieces[p]] == TRUTH.encode_ordinary(text)


def test_split_of_low_code_points_equals_the_full_pattern():
    r, split = random.Random(2), bpe.Splitter(PATTERN)
    for _ in range(2000):
        text = "".join(chr(r.randrange(0x250)) if r.random() < 0.5 else r.choice("ab 's're\n 12éß  ") for _ in range(r.randrange(30)))
        assert split(text) == regex.findall(PATTERN, text)


def test_appends_and_edits_equal_a_new_encoding():
    r = random.Random(3)
    for _ in range(60):
        text = random_text(r, r.randrange(200))
        encoded = bpe.EncodedText(MERGES, PATTERN, text)
        for _ in range(6):
            start = r.choice([len(text), r.randint(0, len(text))])
            stop = min(len(text), start + r.randint(0, 6))
            new = random_text(r, r.randrange(6))
            text = text[:start] + new + text[stop:]
            encoded.replace(start, stop, new)
            assert (encoded.text, encoded.tokens()) == (text, TRUTH.encode_ordinary(text))


def test_an_edit_refills_only_near_it():
    data = b"abcabcthe" * 200
    prefixes = bpe.Prefixes(MERGES, data)
    worked = prefixes.replace(20, 23, b"xyz")
    assert prefixes.last == bpe.Prefixes(MERGES, data[:20] + b"xyz" + data[23:]).last
    assert worked < len(data) / 2


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumnRenamed("row", "ids")  # a column that clashes
    rows = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS).select("doc_id", "text", "source", "ids", "decoded", *bpe.digests()).collect()
    assert len(rows) == docs.count()
    for row in rows:
        text = row["text"] or ""
        assert row["ids"] == TRUTH.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode()
        assert row["n_tokens"] == len(row["ids"])
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, row["ids"])).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.decode(bpe.encode(no_docs(spark), RANKS, PATTERN), RANKS).count() == 0


def test_decode_of_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [464, 3797]), (2, None), (3, [])], "k int, ids array<int>")
    assert {r["k"]: bytes(r["decoded"]) for r in bpe.decode(rows, RANKS).collect()} == {1: b"The cat", 2: b"", 3: b""}
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [999_999])], "k int, ids array<int>"), RANKS).collect()


def test_tokens_of_many_pieces_equal_the_public_library(monkeypatch):
    r, split = random.Random(4), bpe.Splitter(PATTERN)
    texts = ["", *(random_text(r, r.randrange(80)) for _ in range(600)), " " * 60, "=" * 64, "x" * 64, "é" * 64, "x" * 65, "", "y" * 200 + " a " + "z" * 70]
    truth = [TRUTH.encode_ordinary(t) for t in texts]
    for pairs, pieces, together in ((600_000, 200_000, 1 << 14), (40, 30, 7)):  # the second forgets again and again
        monkeypatch.setattr(bpe, "TABLED_PAIRS", pairs)
        monkeypatch.setattr(bpe, "REMEMBERED_PIECES", pieces)
        monkeypatch.setattr(bpe, "TOGETHER", together)
        known = bpe.PieceNumbers(MERGES)
        for size in (1, 50, 700, 3):
            for start in range(0, len(texts), size):
                tokens, borders = known.encode([split(t) for t in texts[start : start + size]])
                got = [tokens[a:b].tolist() for a, b in zip(borders[:-1], borders[1:], strict=True)]
                assert got == truth[start : start + size]
    tokens, _ = known.encode([["\ud800", "\ud800" * 65]])
    assert tokens.tolist() == [*bpe.PieceTokens(MERGES)["\ud800"], *bpe.PieceTokens(MERGES)["\ud800" * 65]]
    assert [len(part) for part in known.encode([])] == [0, 1]


def test_rows_of_one_row_group_are_dealt_to_several_tasks(spark, scratch):
    docs = spark.createDataFrame([(i, f"word{i} and words") for i in range(6000)], "doc_id long, text string")
    folder = scratch("folder")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    rows = queries.all_queries()["op1_byte_bpe"](spark, folder)
    tasks = {r["task"]: r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()}
    assert len(tasks) >= 4 and max(tasks.values()) < 3000
    found = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in rows.collect()}
    assert found == {i: (len(TRUTH.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs.toLocalIterator()}


def test_tables_of_many_pieces_are_read_as_they_are(spark, scratch):
    docs, path = spark.range(4000).selectExpr("id AS doc_id", "'a b' AS text"), scratch("many")
    docs.repartition(16).write.parquet(path)
    rows = spark.read.parquet(path)
    assert spread_large(rows) is rows
    assert spread_large(rows.limit(0)).count() == 0
