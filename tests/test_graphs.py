import itertools
import random
import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from molspark.catalog import views as V
from molspark.catalog.queries import all_queries
from molspark.functions import molgraph as G
from molspark.operators import graphs

# Molecules with their formulas, and strings with the fault they have.
KNOWN = {
    "CCO": "C2H6O", "c1ccccc1": "C6H6", "Cn1cnc2c1c(=O)n(C)c(=O)n2C": "C8H10N4O2", "CC(=O)Oc1ccccc1C(=O)O": "C9H8O4",
    "c1ccc2c(c1)[nH]c1ccccc12": "C12H9N", "O=c1cc[nH]cc1": "C5H5NO", "c1cc[n+]([O-])cc1": "C5H5NO", "C[N+](=O)[O-]": "CH3NO2",
    "CS(=O)(=O)C": "C2H6O2S", "[NH4+].[Cl-]": "ClH4N", "C1.C1": "C2H6", "c1ccc2cccccc12": "C10H8", "F/C=C/F": "C2H2F2",
    "N#CC#N": "C2N2", "[2H]O[2H]": "H2O", "OS(=O)(=O)O": "H2O4S", "C12C3C4C1C5C2C3C45": "C8H8", "[Fe]": "Fe", "c1cc2cccc3c2c(c1)ccc3": "C13H9",
}
FAULTS = {
    "": "empty", "  ": "empty", "C(C": "paren", "C)C": "paren", "C()C": "paren", "[Na+": "character", "C$?C": "character", "CC=": "bond",
    "C==C": "bond", "=C": "bond", "C.": "bond", ".C": "bond", "C1CC": "ring", "C11": "ring", "C12CC12": "ring", "C=1CC#1": "ring", "(1)C": "paren",
    "c1cccc1": "kekule", "n1cccc1": "kekule", "c": "kekule", "C(C)(C)(C)(C)C": "valence", "CC(=O)=C": "valence", "FF(F)F": "valence",
    "[CH5]": "valence", "C[N+](C)(C)(C)C": "valence", "[O-](C)C": "valence",
}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, smiles string")


def test_formulas_and_faults(spark):
    texts = [*KNOWN, *FAULTS, None]
    del texts[list(KNOWN).index("c1cc2cccc3c2c(c1)ccc3")]  # see below: an odd number of atoms has no Kekulé form
    got = {r.smiles: r for r in graphs.composition(graphs.with_graph(frame(spark, texts))).collect()}
    for text, formula in KNOWN.items():
        if text in got:
            assert (got[text].fault, got[text].formula) == (None, formula), text
    assert {text: got[text].fault for text in FAULTS} == FAULTS
    assert got[None].fault == "empty" and got[None].formula is None
    assert G.kekule_orders(*G.parse("c1cc2cccc3c2c(c1)ccc3")) is None


def rings_by_removal(n, bonds):
    """A bond is on a ring if its ends stay connected without it."""
    out = []
    for k, b in enumerate(bonds):
        rest = bonds[:k] + bonds[k + 1 :]
        out.append(G.fragments(n, rest)[b.a] == G.fragments(n, rest)[b.b])
    return out


def random_graph(rng, n):
    pairs = [p for p in itertools.combinations(range(n), 2) if rng.random() < rng.choice([0.15, 0.3, 0.6])]
    rng.shuffle(pairs)
    return pairs


def test_ring_bonds_and_fragments_on_random_graphs():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 9)
        bonds = [G.Bond(a, b, 1, 0, 0) for a, b in random_graph(rng, n)]
        assert G.ring_bonds(n, bonds) == rings_by_removal(n, bonds)


def pairable(nodes, pairs):
    if not nodes:
        return True
    a = min(nodes)
    return any(pairable(nodes - {a, b}, pairs) for b in nodes if (a, b) in pairs or (b, a) in pairs)


def test_matching_against_all_pairings():
    rng = random.Random(2)
    found = 0
    for _ in range(1500):
        n = rng.randrange(0, 11)
        pairs = random_graph(rng, n)
        mate = G.perfect_matching(n, pairs)
        assert (mate is not None) == pairable(frozenset(range(n)), set(pairs))
        if mate is not None:
            found += n > 4
            assert all(mate[mate[i]] == i and ((i, mate[i]) in pairs or (mate[i], i) in pairs) for i in range(n))
    assert found > 100


def test_matching_through_odd_rings():
    # two five-rings joined by a bond between their first atoms: only that bond leaves both even
    ring = lambda s: [(s + i, s + (i + 1) % 5) for i in range(5)]
    assert G.perfect_matching(10, [*ring(0), *ring(5), (0, 5)])[0] == 5
    assert G.perfect_matching(11, [*ring(0), *ring(5), (0, 5), (0, 10)]) is None


ATOMS = ("c", "n", "[nH]", "o", "s", "c(C)", "c(=O)", "n(C)", "[n+](C)", "[cH-]", "[o+]")


def needs(letter):
    return letter in ("c", "c(C)", "n", "[n+](C)", "[o+]")


def test_all_small_rings():
    """Every ring of four to six of these atoms: a Kekulé form exists if the atoms that need a double
    bond lie in runs of even length around the ring."""
    for size in (4, 5, 6):
        for atoms in itertools.product(ATOMS[: 11 if size < 6 else 6], repeat=size):
            text = atoms[0].replace("(", "1(", 1) if "(" in atoms[0] else atoms[0] + "1"
            text += "".join(atoms[1:-1]) + (atoms[-1].replace("(", "1(", 1) if "(" in atoms[-1] else atoms[-1] + "1")
            wanted = [needs(a) for a in atoms]
            if all(wanted):
                possible = size % 2 == 0
            else:
                turn = wanted.index(False)
                runs = "".join("x" if w else " " for w in wanted[turn:] + wanted[:turn]).split()
                possible = all(len(run) % 2 == 0 for run in runs)
            parsed = G.parse(text)
            orders = G.kekule_orders(*parsed)
            assert (orders is not None) == possible, text
            if orders is not None:
                again = G.respell(text, *parsed, orders)
                assert not re.search("[a-z]", again) and G.kekule_orders(*G.parse(again)) is not None
                assert [b.order for b in G.parse(again)[1]] == orders


def test_kekule_forms_keep_the_formula(spark):
    texts = [t for t in KNOWN if t != "c1cc2cccc3c2c(c1)ccc3"]
    once = graphs.kekulize(frame(spark, texts))
    twice = graphs.composition(graphs.with_graph(once, "kekule")).collect()
    assert {r.smiles: r.formula for r in twice} == {t: KNOWN[t] for t in texts}
    assert all(r.kekule.upper() == r.kekule or "Cl" in r.kekule or "Fe" in r.kekule for r in twice)
    atoms = graphs.atom_table(graphs.with_graph(once, "kekule"), "id")
    assert atoms.where("aromatic").count() == 0
    same = ["id", "atom", "symbol", "hydrogens", "degree", "orders"]
    first = graphs.atom_table(graphs.with_graph(once.drop("kekule")), "id").select(same)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, atoms.select(same).collect()))


def test_strict_conversion_fails_the_job(spark):
    assert graphs.kekulize(frame(spark, ["CC", "c1ccccc1"]), strict=True).count() == 2
    with pytest.raises(Exception, match="invalid SMILES: c1cccc1"):
        graphs.kekulize(frame(spark, ["CC", "c1cccc1"]), strict=True).collect()


def test_gate_adds_chemistry_to_the_lexical_checks(spark):
    df = frame(spark, [s for s, _ in V.EXAMPLES] + ["C(C)(C)(C)(C)C", "c1cccc1"]).withColumn("fault", F.lit("kept"))
    got = [r.reasons for r in graphs.chemical_gate(df).orderBy("id").collect()]
    lexical = [[] if e in ("ok", "aromatic") else [e] for _, e in V.EXAMPLES]
    assert [g[:1] for g in got] == [*lexical, ["valence"], ["kekule"]]
    assert graphs.chemical_gate(df).columns == [*df.columns, "reasons"]


def test_atom_and_bond_tables(spark):
    df = frame(spark, ["C[C@@H](N)C(=O)[O-]", "[13CH4].[Na+]"])
    graph = graphs.with_graph(df)
    atoms = [tuple(r) for r in graphs.atom_table(graph, "id").where("id = 1").orderBy("atom").collect()]
    assert atoms == [(1, 0, "C", False, 13, 0, 0, 0, 0, 4, True), (1, 1, "Na", False, None, 1, 0, 0, 1, 0, True)]
    bonds = [tuple(r)[1:] for r in graphs.bond_table(graph, "id").where("id = 0").orderBy("bond").collect()]
    assert bonds == [(0, 0, 1, False, 1), (1, 1, 2, False, 1), (2, 1, 3, False, 1), (3, 3, 4, False, 2), (4, 3, 5, False, 1)]


def test_no_shuffle_long_strings_and_empty_tables(spark):
    df = frame(spark, ["C" * 20_000, "C(" * 5_000 + "C" + ")" * 5_000, "c1ccc(" * 300 + "c1ccccc1" + ")cc1" * 300, "C1" * 3])
    graph = graphs.with_graph(df)
    assert "Exchange" not in plan_of(graphs.atom_table(graph, "id")) + plan_of(graphs.composition(graph))
    got = {r.id: r for r in graphs.composition(graph).select("id", "fault", "n_atoms", "n_rings").collect()}
    assert [(got[i].fault, got[i].n_atoms, got[i].n_rings) for i in range(4)] == [(None, 20_000, 0), (None, 5_001, 0), (None, 1806, 301), ("ring", None, None)]
    assert graphs.atom_table(graphs.with_graph(frame(spark, []).limit(0)), "id").count() == 0


def test_elements_by_group(spark):
    df = frame(spark, ["CCO", "C", "c1cccc1", "OCl"]).withColumn("grp", F.lit("a"))
    got = {r.symbol: (r.n_atoms, r.n_molecules, r.hydrogens) for r in graphs.element_table(graphs.with_graph(df), "grp").collect()}
    assert got == {"C": (3, 2, 9), "O": (2, 2, 2), "Cl": (1, 1, 0)}


def test_molecules_of_one_file_piece_are_dealt_to_tasks(spark, scratch):
    folder = scratch("one-piece")
    parts = spark.range(3000).selectExpr("id p_partkey", "cast(id % 40 + 1 as int) p_size", "'b' p_brand", "1.5d p_retailprice")
    parts.coalesce(1).write.parquet(f"{folder}/part.parquet")
    for name in ("molecule_composition", "chemical_verdicts", "kekulize"):
        rows = all_queries()[name](spark, folder).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in rows) == 3000 and len(rows) == 3 and max(r["count"] for r in rows) < 1200, name


def test_graphs_of_a_batch_are_those_of_its_rows():
    texts = [*KNOWN, None, *FAULTS, "C%12CCCCC%12Cl", "Br", "C1.C1", "[13CH4].c1ccccc1"]
    assert graphs._graphs(texts).to_pylist() == [graphs._graphs([t]).to_pylist()[0] for t in texts]
    (one,) = graphs._graphs(["CBr.O"]).to_pylist()
    assert [(a["symbol"], a["degree"], a["orders"], a["fragment"]) for a in one["atoms"]] == [("C", 1, 1, 0), ("Br", 1, 1, 0), ("O", 0, 0, 2)]
