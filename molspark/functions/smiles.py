r"""Expressions over SMILES strings: generators, tokens and lexical checks.

Everything is a JVM expression. The checks are *lexical*: they look at characters,
brackets, parentheses, bonds and ring labels. Valence, aromaticity rules and
stereochemistry are not examined, so "accepted" does not mean chemically valid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The glyph patterns of the SMILES notation (regular expressions).
OUTER_GLYPH = r"(?s)\[[^\[\]]*\]|Cl|Br|%[0-9][0-9]|."
INNER_GLYPH = r"(?s)@(?:@|TH|AL|SP|TB|OH)?|[A-Z][a-z]|se|as|te|."
BRACKET_ATOM = (
    r"\[[0-9]*(?:[A-Z][a-z]?|se|as|te|[bcnops]|\*)"
    r"(?:@(?:@|TH[0-9]+|AL[0-9]+|SP[0-9]+|TB[0-9]+|OH[0-9]+)?)?"
    r"(?:H[0-9]*)?(?:[+]+[0-9]*|-+[0-9]*)?(?::[0-9]+)?\]"
)
AROMATIC_BRACKET_ATOM = r"\[[0-9]*(?:se|as|te|[bcnops])[^a-z\[\]]*\]"
ILLEGAL_CHARACTER = (
    r"[^BCNOPSFIbcnopslr*()\[\]0-9%=#$:/\\.-]"
    r"|(?:^|[^C])l|(?:^|[^B])r"
)
DANGLING_BOND = r"^[=#$:/\\.-]|[=#$:/\\.-](?:\z|[).])|[=#$:/\\-][=#$:/\\-]|\(\)"
RING_LABEL = r"%[0-9][0-9]|[0-9]"
LONE_PERCENT = r"%(?:\z|[^0-9]|[0-9](?:\z|[^0-9]))"
AROMATIC_ATOM = r"[bcnops]"
WORD = r"[a-z]+"

# Rejection reasons in the order they are reported.
REASONS = ("empty", "bracket", "charset", "paren", "dangling", "ring")


def alkene_smiles(n: Column) -> Column:
    """Linear 1-alkene with ``n`` carbons; shorter than two carbons gives ``C=C``."""
    return F.concat(F.lit("C=C"), F.repeat(F.lit("C"), F.greatest(n.cast("int") - 2, F.lit(0))))


def alcohol_smiles(n: Column, compat: bool = True) -> Column:
    """Linear 1-alcohol for chain label ``n``.

    ``compat=True`` keeps the known off-by-one of the original generator: from n = 2 on
    the string has n - 1 carbons, so labels 1 and 2 both give ``CO``. ``compat=False``
    writes n carbons.
    """
    carbons = F.greatest(n.cast("int") - (1 if compat else 0), F.lit(1))
    return F.concat(F.repeat(F.lit("C"), carbons), F.lit("O"))


def chain_name(n: Column, family: str) -> Column:
    return F.format_string(f"C%d {family}", n.cast("int"))


def carbon_count(smiles: Column) -> Column:
    """Number of ``C`` letters; equals carbon atoms for acyclic, bracket-free strings."""
    return (F.length(smiles) - F.length(F.replace(smiles, F.lit("C"), F.lit("")))).cast("int")


def smiles_tokens(smiles: Column) -> Column:
    """Glyph tokens; bracket atoms are split into element, isotope, chirality and charge.

    Joining the tokens gives the input back, whatever the input is.
    """
    outer = F.regexp_extract_all(smiles, F.lit(OUTER_GLYPH), F.lit(0))
    return F.flatten(
        F.transform(
            outer,
            lambda t: F.when(
                t.startswith("[") & (F.length(t) > 1),
                F.regexp_extract_all(t, F.lit(INNER_GLYPH), F.lit(0)),
            ).otherwise(F.array(t)),
        )
    )


def word_tokens(text: Column) -> Column:
    """Lower-case words of a free text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def skeleton_of(smiles: Column) -> Column:
    """The string with each well-formed bracket atom replaced by ``*``; null counts as empty."""
    return F.regexp_replace(F.coalesce(smiles, F.lit("")), BRACKET_ATOM, "*")


def _paren_imbalance(skeleton: Column) -> Column:
    """True if a parenthesis closes before it opens, or stays open."""
    steps = F.regexp_extract_all(skeleton, F.lit(r"[()]"), F.lit(0))
    depth = F.aggregate(
        steps,
        F.lit(0),
        lambda acc, p: F.when(acc < 0, acc).otherwise(acc + F.when(p == "(", 1).otherwise(-1)),
    )
    return depth != 0


def _ring_imbalance(skeleton: Column) -> Column:
    """True if a ring label occurs an odd number of times."""
    labels = F.transform(
        F.regexp_extract_all(skeleton, F.lit(RING_LABEL), F.lit(0)),
        lambda t: F.replace(t, F.lit("%"), F.lit("")).cast("int"),
    )
    odd = F.filter(
        F.array_distinct(labels),
        lambda label: F.size(F.filter(labels, lambda other: other == label)) % 2 == 1,
    )
    return F.size(odd) > 0


def reject_reasons(smiles: Column, skeleton: Column | None = None) -> Column:
    """Array of the reasons, in ``REASONS`` order, why a string is rejected; null is empty.

    Pass the skeleton as a column of its own to have it computed once per row.
    """
    text = F.coalesce(smiles, F.lit(""))
    skeleton = skeleton_of(smiles) if skeleton is None else skeleton
    failed = {
        "empty": F.trim(text) == "",
        "bracket": skeleton.rlike(r"[\[\]]"),
        "charset": skeleton.rlike(ILLEGAL_CHARACTER),
        "paren": _paren_imbalance(skeleton),
        "dangling": skeleton.rlike(DANGLING_BOND),
        "ring": skeleton.rlike(LONE_PERCENT) | _ring_imbalance(skeleton),
    }
    return F.array_compact(
        F.array(*[F.when(failed[reason], F.lit(reason)) for reason in REASONS])
    )


def aromatic_atoms(smiles: Column, skeleton: Column | None = None) -> Column:
    """Number of atoms in lower-case aromatic notation, inside and outside brackets."""
    skeleton = skeleton_of(smiles) if skeleton is None else skeleton
    outside = F.regexp_count(skeleton, F.lit(AROMATIC_ATOM))
    inside = F.regexp_count(F.coalesce(smiles, F.lit("")), F.lit(AROMATIC_BRACKET_ATOM))
    return outside + inside
