"""Molecular graphs: tables of atoms and bonds, valence, composition, and Kekulé forms.

Strings are parsed once, in Arrow batches, into arrays of atoms and bonds in the row of their molecule.
Hydrogens, valence, formulas and counts are expressions over these arrays, so none of them moves a
row; the tables of atoms and bonds are explosions of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molspark.functions import molgraph as G
from molspark.operators.molecules import validate

# Normal valences of the elements that may stand outside brackets, and a few more.
VALENCES = {
    "H": [1], "B": [3], "C": [4], "N": [3, 5], "O": [2], "F": [1], "Si": [4], "P": [3, 5], "S": [2, 4, 6], "Cl": [1],
    "As": [3, 5], "Se": [2, 4, 6], "Br": [1], "I": [1],
}

_PARSED = (
    "atoms array<struct<atom:int, symbol:string, aromatic:boolean, bracket:boolean, isotope:int, charge:int, written:int, degree:int, orders:int, fragment:int>>, "
    "bonds array<struct<bond:int, a:int, b:int, aromatic:boolean, `order`:int>>, fault string, kekule string"
)
_ARROW = pa.struct([
    ("atoms", pa.list_(pa.struct([("atom", pa.int32()), ("symbol", pa.string()), ("aromatic", pa.bool_()), ("bracket", pa.bool_()), ("isotope", pa.int32()), ("charge", pa.int32()), ("written", pa.int32()), ("degree", pa.int32()), ("orders", pa.int32()), ("fragment", pa.int32())]))),
    ("bonds", pa.list_(pa.struct([("bond", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("aromatic", pa.bool_()), ("order", pa.int32())]))),
    ("fault", pa.string()),
    ("kekule", pa.string()),
])


def _graphs(texts: list[str | None]) -> pa.StructArray:
    """Molecules as nested rows, gathered by column. Orders are those of the Kekulé form, null where
    there is none."""
    atoms, bonds, orders, least = [], [], [], []
    n_atoms, n_bonds, known, faults, kekules = [], [], [], [], []
    for text in texts:
        try:
            own, links = G.parse(text)
        except G.BadMolecule as bad:
            own, links, found, fault = [], [], None, bad.args[0]
        else:
            found = G.kekule_orders(own, links)
            fault = "kekule" if found is None else None
        atoms += own
        bonds += links
        orders += [0] * len(links) if found is None else found
        # without a dot every atom is bonded with an earlier one
        least += G.fragments(len(own), links) if own and "." in text else [0] * len(own)
        n_atoms.append(len(own))
        n_bonds.append(len(links))
        known.append(found is not None)
        faults.append(fault)
        kekules.append(None if found is None else G.respell(text, own, links, found))
    symbol, aromatic, bracket, isotope, charge, written, _, _ = zip(*atoms, strict=True) if atoms else [()] * 8
    a, b, order, _, _ = (np.array(x, np.int32) for x in (zip(*bonds, strict=True) if bonds else [()] * 5))
    starts, firsts = (np.concatenate([[0], np.cumsum(n)]).astype(np.int32) for n in (n_atoms, n_bonds))
    shift = np.repeat(starts[:-1], n_bonds)
    ends = np.concatenate([a + shift, b + shift])
    spelled = np.array(orders, np.int32)
    degree = np.bincount(ends, minlength=len(atoms))
    sums = np.bincount(ends, np.concatenate([spelled, spelled]), minlength=len(atoms))
    number, link = (np.arange(first[-1], dtype=np.int32) - np.repeat(first[:-1], n) for first, n in ((starts, n_atoms), (firsts, n_bonds)))
    known = np.array(known, bool)
    columns = [
        number, pa.array(symbol, pa.string()), pa.array(aromatic, pa.bool_()), pa.array(bracket, pa.bool_()), pa.array(isotope, pa.int32()),
        pa.array(charge, pa.int32()), pa.array(written, pa.int32()), degree.astype(np.int32),
        pa.array(sums.astype(np.int32), mask=~np.repeat(known, n_atoms)), pa.array(least, pa.int32()),
    ]
    pairs = [link, a, b, order == G.AROMATIC, pa.array(spelled, mask=~np.repeat(known, n_bonds))]
    lists = [
        pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays([pa.array(x) for x in values], fields=list(_ARROW.field(name).type.value_type)))
        for name, first, values in (("atoms", starts, columns), ("bonds", firsts, pairs))
    ]
    return pa.StructArray.from_arrays([*lists, pa.array(faults, pa.string()), pa.array(kekules, pa.string())], fields=list(_ARROW))


def _valences(symbol: Column, charge: Column) -> Column:
    """Valences an element may have at a charge, an empty array for elements without a rule. A charge
    takes a bond from carbon and its kin, gives one to negative boron; the elements to the right gain
    a bond by a plus and lose one by a minus. Charged nitrogen has its least valence only."""
    table = F.create_map(*(x for name, values in VALENCES.items() for x in (F.lit(name), F.array(*map(F.lit, values)))))
    normal = F.coalesce(F.try_element_at(table, symbol), F.array().cast("array<int>"))
    shift = F.when(symbol.isin("C", "Si", "H"), -F.abs(charge)).when(symbol == "B", -charge).otherwise(charge)
    charged = F.when(symbol == "N", F.slice(normal, 1, 1)).otherwise(normal)
    return F.when(charge == 0, normal).otherwise(F.transform(charged, lambda v: F.greatest(v + shift, F.lit(0))))


def _with_hydrogens(atoms: Column) -> Column:
    """The atoms with their hydrogens and whether their bonds are possible. Outside brackets an atom is
    filled up to its least possible valence; inside, hydrogens are as written, and fewer than the
    valence asks for are allowed. Each step is a pass of its own, so that no value is computed twice."""

    def hydrogens(x: Column) -> Column:
        atom = x["atom"]
        filled = F.coalesce(F.array_min(F.filter(x["allowed"], lambda v: v >= atom["orders"])) - atom["orders"], F.lit(0))
        return F.when(atom["bracket"], atom["written"]).when(atom["orders"].isNotNull(), filled).cast("int")

    def whole(x: Column) -> Column:
        atom, most = x["atom"], F.array_max(x["allowed"])
        fits = most.isNull() | (atom["orders"] + F.coalesce(x["hydrogens"], F.lit(0)) <= most)
        kept = [atom[name].alias(name) for name in ("atom", "symbol", "aromatic", "isotope", "charge", "degree", "orders", "fragment")]
        return F.struct(*kept, x["hydrogens"].alias("hydrogens"), fits.alias("fits"))

    allowed = F.transform(atoms, lambda a: F.struct(a.alias("atom"), _valences(a["symbol"], a["charge"]).alias("allowed")))
    filled = F.transform(allowed, lambda x: F.struct(x["atom"].alias("atom"), x["allowed"].alias("allowed"), hydrogens(x).alias("hydrogens")))
    return F.transform(filled, whole)


def with_graph(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """``df`` with the columns atoms, bonds, fault and kekule; columns of these names are replaced.

    ``fault`` is null for a molecule that is chemically possible, else the first of: empty (null and
    blank too), character, paren, bond, ring, kekule (aromatic notation without a placement of double
    bonds), valence (an atom with more bonds than its element allows). ``kekule`` is the string without
    aromatic notation, null where it cannot be written."""
    kept = [name for name in df.columns if name not in ("atoms", "bonds", "fault", "kekule")]
    schema = T.StructType([*(df.schema[name] for name in kept), T.StructField("_graph", T.StructType.fromDDL(_PARSED))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                rows = batch.slice(start, 1024)
                graphs = _graphs(rows.column(len(kept)).to_pylist())
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], graphs], [*kept, "_graph"])

    parsed = df.select(*kept, F.col(smiles).alias("_text")).mapInArrow(run, schema)
    atoms = parsed.withColumn("atoms", _with_hydrogens(F.col("_graph.atoms")))
    fault = F.coalesce(F.col("_graph.fault"), F.when(~F.forall("atoms", lambda a: a["fits"]), F.lit("valence")))
    return atoms.select(*kept, "atoms", F.col("_graph.bonds").alias("bonds"), fault.alias("fault"), F.col("_graph.kekule").alias("kekule"))


def atom_table(graphs: DataFrame, key: str) -> DataFrame:
    """One row per atom: key, atom, symbol, aromatic, isotope, charge, degree (bonds), orders (their
    sum), fragment (least atom of its connected part), hydrogens, fits."""
    return graphs.select(key, F.explode("atoms").alias("_a")).select(key, "_a.*")


def bond_table(graphs: DataFrame, key: str) -> DataFrame:
    """One row per bond: key, bond, a, b, aromatic, order (in the Kekulé form)."""
    return graphs.select(key, F.explode("bonds").alias("_b")).select(key, "_b.*")


def _letters(atoms: Column, hydrogens: Column) -> Column:
    """The elements by letter."""
    none = F.array().cast("array<string>")
    return F.sort_array(F.array_distinct(F.concat(F.transform(atoms, lambda a: a["symbol"]), F.when(hydrogens > 0, F.array(F.lit("H"))).otherwise(none))))


def _in_order(letters: Column) -> Column:
    """Carbon, hydrogen, then by letter; without carbon all by letter."""
    first = F.array(F.lit("C"), F.lit("H"))
    return F.when(F.array_contains(letters, "C"), F.concat(F.array_intersect(first, letters), F.array_except(letters, first))).otherwise(letters)


def _formula(order: Column, atoms: Column, hydrogens: Column) -> Column:
    """Elements with their counts."""

    def part(symbol):
        n = F.size(F.filter(atoms, lambda a: a["symbol"] == symbol)) + F.when(symbol == "H", hydrogens).otherwise(0)
        return F.concat(symbol, F.when(n > 1, n.cast("string")).otherwise(""))

    return F.array_join(F.transform(order, part), "")


def composition(graphs: DataFrame) -> DataFrame:
    """``graphs`` with n_atoms, n_bonds, n_fragments, n_rings, n_hydrogens, charge and formula in place of
    the arrays; these are null for molecules with a fault other than valence."""
    atoms, bonds = F.col("atoms"), F.col("bonds")
    known = F.col("fault").isNull() | (F.col("fault") == "valence")
    total = lambda name: F.aggregate(atoms, F.lit(0), lambda acc, a: acc + a[name])
    fragments = F.size(F.array_distinct(F.transform(atoms, lambda a: a["fragment"])))
    found = {
        "n_atoms": F.size(atoms), "n_bonds": F.size(bonds), "n_fragments": fragments, "n_rings": F.size(bonds) - F.size(atoms) + fragments,
        "n_hydrogens": total("hydrogens"), "charge": total("charge"),
    }
    found = graphs.withColumns({name: F.when(known, value) for name, value in found.items()})
    found = found.withColumn("_letters", _letters(F.col("atoms"), F.col("n_hydrogens")))
    formula = _formula(_in_order(F.col("_letters")), F.col("atoms"), F.col("n_hydrogens"))
    return found.withColumn("formula", F.when(known, formula)).drop("atoms", "bonds", "_letters")


def element_table(graphs: DataFrame, group: str) -> DataFrame:
    """Atoms by group and element over molecules without a fault: group, symbol, n_atoms, n_molecules,
    hydrogens. Counted per molecule before the shuffle."""
    whole = graphs.where("fault is null")
    symbols = F.array_distinct(F.transform("atoms", lambda a: a["symbol"]))
    counts = whole.select(group, "atoms", F.explode(symbols).alias("symbol")).select(
        group, "symbol", F.filter("atoms", lambda a: a["symbol"] == F.col("symbol")).alias("own")
    )
    carried = F.aggregate("own", F.lit(0), lambda acc, a: acc + a["hydrogens"])
    return counts.groupBy(group, "symbol").agg(F.sum(F.size("own")).alias("n_atoms"), F.count("*").alias("n_molecules"), F.sum(carried).alias("hydrogens"))


def chemical_gate(df: DataFrame, smiles: str = "smiles") -> DataFrame:
    """``df`` with ``reasons``: those of the lexical checks, and the graph's fault if there are none.
    What ``quarantine`` accepts by letters this accepts only if every atom's valence allows it."""
    graphs = with_graph(validate(df, smiles).select(*df.columns, "reasons"), smiles)
    reasons = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array_compact(F.array("fault")))
    return graphs.select(*df.columns, reasons.alias("reasons"))


def kekulize(df: DataFrame, smiles: str = "smiles", strict: bool = False) -> DataFrame:
    """``df`` with ``kekule``, the string in single and double bonds, and ``fault`` where it is null.

    Strings without aromatic notation stay as they are. With ``strict`` the first fault fails the job
    that reads the result, as the original's conversion does."""
    graphs = with_graph(df, smiles).select(*(n for n in df.columns if n not in ("kekule", "fault")), "kekule", "fault")
    graphs = graphs.withColumn("kekule", F.when(F.col("fault").isNull(), F.col("kekule")))
    if strict:
        message = F.concat(F.lit("invalid SMILES: "), F.coalesce(F.col(smiles), F.lit("null")))
        graphs = graphs.filter(F.when(F.col("fault").isNull(), True).otherwise(F.raise_error(message).cast("boolean")))
    return graphs
