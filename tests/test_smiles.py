import re

import pytest
from pyspark.sql import functions as F

from molspark.catalog.views import EXAMPLES
from molspark.functions import smiles as S
from molspark.operators import molecules as M


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, smiles string")


def tokens_of(spark, text):
    return frame(spark, [text]).select(S.smiles_tokens(F.col("smiles")).alias("t")).first().t


def test_bracket_atoms_are_split_into_glyphs(spark):
    expected = "C [ C @@ H ] ( N ) C ( = O ) [ O - ] Cl %12 c 1 c c c c c 1".split()
    assert tokens_of(spark, "C[C@@H](N)C(=O)[O-]Cl%12c1ccccc1") == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", []),
        ("Cn1cnc2", list("Cn1cnc2")),
        ("[Na+].[Cl-]", ["[", "Na", "+", "]", ".", "[", "Cl", "-", "]"]),
        ("[13CH4]", ["[", "1", "3", "C", "H", "4", "]"]),
        ("[se]1", ["[", "se", "]", "1"]),
        ("[Cn]", ["[", "Cn", "]"]),
        ("[C@TH1H]", ["[", "C", "@TH", "1", "H", "]"]),
        ("[Na", ["[", "N", "a"]),
    ],
)
def test_tokens(spark, text, expected):
    assert tokens_of(spark, text) == expected


def test_tokens_join_to_the_input(spark):
    texts = [s for s, _ in EXAMPLES] + ["a\nb[\n]c", "][[]]", "Å\U0001f600[é]", "C" * 2000, "[" * 50]
    rows = frame(spark, texts).select("smiles", F.array_join(S.smiles_tokens(F.col("smiles")), "").alias("back"))
    assert all(r.smiles == r.back for r in rows.collect())


def test_null_has_no_tokens(spark):
    assert tokens_of(spark, None) is None


def test_examples_get_their_verdict(spark):
    checked = M.validate(frame(spark, [s for s, _ in EXAMPLES])).orderBy("id").collect()
    assert [r.verdict for r in checked] == [e for _, e in EXAMPLES]


@pytest.mark.parametrize(
    ("text", "reasons"),
    [
        (None, ["empty"]),
        ("  ", ["empty", "charset"]),
        (")C(", ["paren"]),
        ("C)(C", ["paren"]),
        ("C()C", ["dangling"]),
        ("C((C)(C))C", []),
        ("=CC", ["dangling"]),
        ("C==C", ["dangling"]),
        ("C(=)C", ["dangling"]),
        ("C..C", ["dangling"]),
        ("F/C=C\\F", []),
        ("C1CC1C1CC1", []),
        ("C1CC2", ["ring"]),
        ("C%1CC", ["ring"]),
        ("C%01CC1", []),
        ("[]", ["bracket"]),
        ("C]C", ["bracket"]),
        ("[C[C]]", ["bracket"]),
        ("[Fe+2]", []),
        ("[nH]1cccc1", []),
        ("[C@@H](F)(Cl)Br", []),
        ("[OH:1]C", []),
        ("lC", ["charset"]),
        ("C r", ["charset"]),
        ("Xe", ["charset"]),
    ],
)
def test_reasons(spark, text, reasons):
    row = frame(spark, [text]).select(S.reject_reasons(F.col("smiles")).alias("r")).first()
    assert row.r == reasons


def paren_ok(text):
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return depth == 0


def rings_ok(text):
    labels = [int(t.replace("%", "")) for t in re.findall(r"%\d\d|\d", text)]
    return all(labels.count(x) % 2 == 0 for x in labels)


def test_paren_and_ring_checks_against_brute_force(spark):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice(["(", ")", "C", "1", "2", "%11"]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    for row in M.validate(frame(spark, texts)).collect():
        assert ("paren" in row.reasons) == (not paren_ok(row.smiles)), row.smiles
        assert ("ring" in row.reasons) == (not rings_ok(row.smiles)), row.smiles


def test_accepted_and_rejected_make_the_input(spark):
    df = frame(spark, [s for s, _ in EXAMPLES] + [None])
    accepted, rejected = M.quarantine(df)
    assert accepted.count() + rejected.count() == df.count()
    report = {r.verdict: r.n_rows for r in M.validation_report(M.validate(df)).collect()}
    assert sum(report.values()) == len(EXAMPLES) + 1
    assert report["empty"] == 2


def test_strict_validation_fails_the_job(spark):
    accepted, rejected = M.quarantine(frame(spark, ["CC", "C(C"]), strict=True)
    assert rejected.count() == 0
    with pytest.raises(Exception, match="invalid SMILES"):
        accepted.select("id").collect()
    assert M.quarantine(frame(spark, ["CC"]), strict=True)[0].count() == 1


def test_aromatic_audit(spark):
    df = frame(spark, ["c1ccccc1", "[nH]1cccc1", "CCl", "[Sn]", "[Cn]", None]).withColumn("source", F.lit("a"))
    row = M.aromatic_audit(df, "source").first()
    assert (row.n_rows, row.n_aromatic, row.aromatic_atoms) == (6, 2, 11)
    assert row.share == pytest.approx(2 / 6)


def test_series_reproduces_the_known_strings(spark):
    rows = {(r.family, r.carbons): r for r in M.homologous_series(spark).collect()}
    assert len(rows) == 24
    assert rows["alkene", 2].smiles == "C=C"
    assert rows["alkene", 24].smiles == "C=C" + "C" * 22
    assert rows["alcohol", 2].smiles == "CO"
    assert rows["alcohol", 4].smiles == "CCCO"
    assert rows["alcohol", 4].name == "C4 Alcohol"
    assert sorted({c for _, c in rows}) == list(range(2, 25, 2))


def test_short_chains(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "n int")
    row = df.select(S.alkene_smiles(F.col("n")).alias("e"), S.alcohol_smiles(F.col("n")).alias("o")).collect()
    assert [(r.e, r.o) for r in row] == [("C=C", "CO"), ("C=C", "CO"), ("C=CC", "CCO")]


def test_carbon_mismatch_shows_the_off_by_one(spark):
    compat = M.carbon_mismatch(M.homologous_series(spark))
    assert {r.family for r in compat.collect()} == {"alcohol"}
    assert compat.count() == 12
    assert M.carbon_mismatch(M.homologous_series(spark, compat=False)).count() == 0
