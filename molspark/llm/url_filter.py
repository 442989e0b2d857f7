"""URL filter: explicit host and path rules, and a character language-model ratio for the rest.

Two variable-order Markov models over URL symbols, one of accepted and one of rejected URLs, are
counted from the URLs that a rule decides. An n-gram's probability in its longest known context
is smoothed by that of the next shorter context (Witten-Bell weights), down to a uniform base.
The verdict compares the mean log-likelihood difference per symbol with a threshold calibrated
on rule-decided URLs that were held back from counting.

Symbols come from a fixed alphabet, so all n-grams up to ``ORDER`` have a number below
``SIZE ** ORDER`` and the model is one array of at most ``SIZE ** ORDER`` differences, whatever
the input. Scoring is an array look-up per symbol inside the scan; everything is DataFrame
expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molspark.llm.common import ascii_lower

#: Symbols of the models, numbered from 1; digits share one, all others are 0.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0/.-_?=&#:%~+"
DIGITS = "0123456789"
SIZE = len(SYMBOLS) + 1
ORDER = 3
#: Calibration takes the mean differences in steps of this size, cut at plus and minus 8.
STEP, LIMIT = 0.01, 8.0


@dataclass(frozen=True)
class Rule:
    """Host with all its subdomains, and the start of the path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), after


def match_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null without one. Of rules of equal
    length the first by text, then block before allow, wins."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text, r.verdict != "block"), reverse=True):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def symbols(url: Column) -> Column:
    """Array of symbol numbers of the whole url, lower-cased; empty for null."""
    lowered = F.translate(ascii_lower(F.coalesce(url, F.lit(""))), DIGITS, "0" * len(DIGITS))
    characters = F.filter(F.split(lowered, "", -1), lambda c: c != "")
    return F.transform(characters, lambda c: F.instr(F.lit(SYMBOLS), c))


def grams(codes: Column) -> Column:
    """Number of the ``ORDER`` symbols that end at each place; symbols before the start are 0."""

    def number(code: Column, at: Column) -> Column:
        total = code
        for back in range(1, ORDER):
            before = F.when(at >= back, F.element_at(codes, F.greatest(at - back + 1, F.lit(1)))).otherwise(F.lit(0))
            total = total + before * SIZE**back
        return total

    return F.transform(codes, number)


def count_grams(labelled: DataFrame) -> DataFrame:
    """(gram, accepted, rejected) of all places of all rows (codes, accepted); at most
    ``SIZE ** ORDER`` rows, summed per task first."""
    places = labelled.select("accepted", F.explode(grams(F.col("codes"))).alias("gram"))
    one = lambda kind: F.sum(F.when(kind, 1).otherwise(0))
    return places.groupBy("gram").agg(one(F.col("accepted")).alias("accepted"), one(~F.col("accepted")).alias("rejected"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio) for every possible gram: log-likelihood difference of its last symbol in
    its longest known context, 0 for a symbol that neither class has."""
    classes = ("accepted", "rejected")
    dense = counts.sparkSession.range(SIZE**ORDER).withColumnRenamed("id", "gram").withColumn("ratio", F.lit(0.0))
    lower = None
    for length in range(1, ORDER + 1):
        size = SIZE**length
        counted = counts.groupBy(F.pmod("gram", F.lit(size)).alias("tail")).agg(*[F.sum(c).alias(c) for c in classes])
        counted = counted.withColumn("context", F.floor(F.col("tail") / SIZE))
        totals = counted.groupBy("context").agg(
            *[F.sum(c).alias(f"n_{c}") for c in classes],
            *[F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).alias(f"kinds_{c}") for c in classes],
        )
        joined = counted.join(totals, "context")
        if lower is None:
            joined = joined.withColumns({f"p_{c}": F.lit(1.0 / SIZE) for c in classes})
        else:
            joined = joined.withColumn("shorter", F.pmod("tail", F.lit(SIZE ** (length - 1)))).join(lower, "shorter")
        new = {}
        for c in classes:  # a class without the context has n and kinds 0 and takes the shorter context's probability
            weight = F.greatest(F.col(f"kinds_{c}"), F.when(F.col(f"n_{c}") == 0, 1).otherwise(0))
            new[c] = ((F.col(c) + weight * F.col(f"p_{c}")) / (F.col(f"n_{c}") + weight)).alias(f"p_{c}")
        step = joined.select(F.col("tail").alias("shorter"), *new.values())
        known = step.select(F.col("shorter").alias("known"), (F.log("p_accepted") - F.log("p_rejected")).alias("longer"))
        dense = dense.join(known, F.pmod("gram", F.lit(size)) == F.col("known"), "left")
        dense = dense.select("gram", F.coalesce("longer", "ratio").alias("ratio"))
        lower = step
    return dense


def fit_scorer(labelled: DataFrame) -> Callable[[Column], Column]:
    """From rows (codes, accepted) to a function of a codes column: the mean log-likelihood
    difference per symbol, 0 for an empty url. The model travels as one literal array of
    ``SIZE ** ORDER`` numbers."""
    values = F.transform(F.sort_array(F.collect_list(F.struct("gram", "ratio"))), lambda x: F.format_string("%.4f", x["ratio"]))
    written = log_ratios(count_grams(labelled)).agg(F.array_join(values, ",").alias("values")).first()["values"]
    model = F.split(F.lit(written), ",").cast("array<double>")

    def score(codes: Column) -> Column:
        start = F.struct(F.lit(0).alias("gram"), F.lit(0.0).alias("total"))

        def step(state: Column, code: Column) -> Column:
            gram = F.pmod(state["gram"] * SIZE + code, F.lit(SIZE**ORDER)).cast("int")
            return F.struct(gram.alias("gram"), (state["total"] + F.element_at(model, gram + 1)).alias("total"))

        total = F.aggregate(codes, start, step, lambda state: state["total"])
        return F.when(F.size(codes) > 0, total / F.size(codes)).otherwise(F.lit(0.0))

    return score


def calibrate(held_back: DataFrame) -> float:
    """The threshold on (score, accepted) rows with the best mean of both classes' hit rates; of
    equal ones that nearest to 0. 0 if a class is missing. Only a histogram of at most
    2 * LIMIT / STEP + 1 bins is collected."""
    bins = F.round(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("score"))) / STEP).cast("int")
    found = held_back.groupBy(bins.alias("bin")).agg(
        F.sum(F.when(F.col("accepted"), 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("accepted"), 0).otherwise(1)).alias("r")
    )
    rows = sorted((r["bin"], r["a"], r["r"]) for r in found.collect())
    accepted, rejected = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not accepted or not rejected:
        return 0.0
    best, below_a, below_r = [], 0, 0
    for (bin_, a, r), after in zip(rows, [*rows[1:], (rows[-1][0] + 2, 0, 0)], strict=True):
        below_a, below_r = below_a + a, below_r + r
        threshold = (bin_ + after[0]) / 2 * STEP
        best.append((-(1 - below_a / accepted + below_r / rejected), abs(threshold), threshold))
    return min(best)[2]


def judge(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``pages``: the id, host, path, rule, verdict and score.

    Null urls and urls without ``://`` have empty host and path, fit no rule and are judged by
    the model on what text they have (score 0 without any). A score at the threshold is
    allowed. Repeated rows get repeated verdicts, an empty table gives an empty one, and without
    URLs decided by rules on both sides the model says 0 and allows. Other columns are ignored.
    """
    host, path = split_url(F.col(url))
    split = pages.select(F.col(page_id), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rule, ruled = match_rule(F.col("host"), F.col("path"), rules)
    split = split.withColumns({"rule": rule, "ruled": ruled, "codes": symbols(F.col("url"))})
    decided = split.where(F.col("ruled").isNotNull())
    labelled = decided.select("codes", (F.col("ruled") == "allow").alias("accepted"), (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("held"))
    score = fit_scorer(labelled.where(~F.col("held")))
    threshold = calibrate(labelled.where("held").select("accepted", score(F.col("codes")).alias("score")))
    scored = split.withColumn("score", score(F.col("codes")))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select(page_id, "host", "path", "rule", verdict.alias("verdict"), "score")
