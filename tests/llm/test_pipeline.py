import corpus_pipeline
import public_tokenizers
import tiktoken
from molspark.llm import bpe
from molspark.llm.common import read_table
from molspark.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_each_on_its_input(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "copies", "near-copies", "mix", "bpe"]
    docs = read_table(spark, SF, "documents")
    extra = [(9001, None, "en", "s", 0), (9002, "12 34 !!", "en", "s", 8), (9003, "", "en", "s", 0)]
    first = docs.orderBy("doc_id").first()
    words = first["text"].split()
    extra += [(9004, first["text"], "en", "s", 0), (9005, " ".join([*words[:-1], "changed"]), "en", "s", 0)]
    docs = materialize(docs.unionByName(spark.createDataFrame(extra, docs.schema)), "test-docs")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], SF), f"test-{name}"))
        assert kept[-1].columns[: len(columns)] == columns
    ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in kept]
    assert ids[0] - ids[1] == {9001, 9002, 9003}
    assert first["doc_id"] not in ids[2] and 9004 in ids[2]
    texts = [r["text"] for r in kept[2].collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {r["text"] for r in kept[1].collect()}
    assert (9004 in ids[3]) and (9005 not in ids[3])
    assert ids[4] <= ids[3] and len(ids[4]) > 0.8 * len(ids[3])
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    truth = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r["ids"] == truth.encode_ordinary(r["text"]) for r in kept[5].limit(50).collect())


def test_run_has_the_rows_of_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*read_table(spark, SF, "documents").columns, "ids"]
    assert out.count() > 0
