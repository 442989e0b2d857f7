import pytest
from pyspark.sql import functions as F

from molspark.functions.smiles import smiles_tokens
from molspark.functions import mlp
from molspark.operators.heads import Head, score
from molspark.operators.molecules import validate
from molspark.operators.vocab import build_vocabulary, encode
from molspark.sources import artifacts, tables
from molspark.streaming.files import stream_files, tokenize_accepted
from molspark.session import scratch_path, shared_dir


def test_csv_quarantines_bad_lines(spark, scratch):
    path = scratch("csv")
    lines = ["smiles,lumo", "CCO,0.5", "C=C,oops", '"C,C",1.5', "C1CC1,", "too,1.0,many"]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    good, bad = tables.split_corrupt(tables.read_csv(spark, path, "smiles string, lumo double"))
    assert {(r.smiles, r.lumo) for r in good.collect()} == {("CCO", 0.5), ("C,C", 1.5), ("C1CC1", None)}
    assert {r[tables.CORRUPT] for r in bad.collect()} == {"C=C,oops", "too,1.0,many"}
    assert {r.smiles for r in good.select("smiles").collect()} == {"CCO", "C,C", "C1CC1"}
    assert (good.count(), bad.count()) == (3, 2)
    assert bad.select("smiles").count() == 2


def test_csv_headers(spark, scratch):
    path = scratch("csv")
    for part, lines in enumerate((["smiles,lumo", "C,1.0", ""], ["smiles,lumo", "CC,2.0"])):
        spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(f"{path}/{part}")
    rows = tables.read_csv(spark, f"{path}/*", "smiles string, lumo double").collect()
    assert {(r.smiles, r.lumo, r[tables.CORRUPT]) for r in rows} == {("C", 1.0, None), ("CC", 2.0, None)}
    with pytest.raises(ValueError, match="first line"):
        tables.read_csv(spark, f"{path}/*", "lumo double, smiles string")
    assert tables.read_csv(spark, f"{path}/1", "a string, b string", header=False).count() == 2


def test_csv_inference(spark, scratch):
    path = scratch("csv")
    tables.write_csv(spark.createDataFrame([("C", 0.5)], "smiles string, lumo double"), path)
    assert dict(tables.infer_csv(spark, path).dtypes) == {"smiles": "string", "lumo": "double"}


def test_predictions_are_pruned_by_property(spark, scratch):
    path = scratch("predictions")
    rows = spark.createDataFrame([(1, "bp", 2.0), (1, "mp", 3.0)], "mol_id bigint, property string, value double")
    tables.write_predictions(rows, path)
    back = tables.read_predictions(spark, path, "mol_id bigint, value double, property string")
    assert {tuple(r) for r in back.select("mol_id", "property", "value").collect()} == {(1, "bp", 2.0), (1, "mp", 3.0)}
    plan = back.filter("property = 'bp'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(property" in plan


def test_split_table_is_pruned_by_side(spark, scratch):
    path = scratch("split")
    tables.write_split(spark.range(10).withColumn("split", F.when(F.col("id") < 2, "test").otherwise("train")), path)
    assert spark.read.parquet(path).filter("split = 'test'").count() == 2


def test_quarantine_is_written_once_and_pruned(spark, scratch):
    df = spark.createDataFrame([(1, "CC"), (2, "C(C"), (3, None)], "id int, smiles string")
    accepted, rejected = tables.write_quarantine(validate(df), scratch("quarantine"))
    assert [r.id for r in accepted.collect()] == [1]
    assert {(r.id, tuple(r.reasons)) for r in rejected.collect()} == {(2, ("paren",)), (3, ("empty",))}
    assert "PartitionFilters: [isnotnull(accepted" in accepted._jdf.queryExecution().toString()


def test_vocabulary_round_trip(spark, scratch):
    df = spark.createDataFrame([("CCO",)], "smiles string")
    vocab = build_vocabulary(df, smiles_tokens(F.col("smiles")))
    path = scratch("vocab")
    artifacts.save_vocabulary(vocab, path)
    assert sorted(artifacts.load_vocabulary(spark, path).collect()) == sorted(vocab.collect())


def test_stream_equals_batch(spark, scratch):
    source, target, checkpoint = scratch("in"), scratch("out"), scratch("checkpoint")
    df = spark.range(60).select("id", F.concat(F.lit("C[O-]"), F.repeat(F.lit("("), (F.col("id") % 2).cast("int"))).alias("smiles"))
    df.repartition(3).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        stream_files(spark, source, "id bigint, smiles string", tokenize_accepted, target, checkpoint, 1).awaitTermination()
    streamed = spark.read.parquet(target).orderBy("id").collect()
    assert streamed == tokenize_accepted(df).orderBy("id").collect()


def test_encoding_and_scoring_accept_a_stream(spark, scratch):
    source, target, checkpoint = scratch("in"), scratch("out"), scratch("checkpoint")
    df = spark.range(40).select(
        "id", F.repeat(F.lit("CO"), (F.col("id") % 5).cast("int")).alias("smiles"), F.array("id", F.lit(1)).alias("x")
    )
    df.repartition(2).write.parquet(source)
    tokens = smiles_tokens(F.col("smiles"))
    vocab = build_vocabulary(df, tokens)
    head = Head(2, 1, mlp.init_parameters(2, 1, 0))

    def transform(rows):
        scored = rows.withColumn("y_pred", score("x", head))
        return encode(scored.select(F.struct("id", "y_pred").alias("row"), "smiles"), "row", tokens, vocab)

    stream_files(
        spark, source, "id bigint, smiles string, x array<bigint>", transform, target, checkpoint
    ).awaitTermination()
    streamed = spark.read.parquet(target).orderBy("row.id").collect()
    assert streamed == transform(df).orderBy("row.id").collect()


def test_scratch_paths_are_under_the_shared_folder(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b
    assert a.startswith(shared_dir(spark).rstrip("/"))
