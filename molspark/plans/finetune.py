"""From a labelled table to a fitted head and its report."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molspark.functions.smiles import smiles_tokens
from molspark.functions.vectors import linear
from molspark.operators.heads import Head, HeadParams, fit_head, fit_line, score, sweep
from molspark.operators.reports import regression_report, regression_report_by, rename_column
from molspark.operators.search import PARAMETERS, best_trial, random_trials
from molspark.operators.splits import train_test_split
from molspark.operators.vocab import build_vocabulary, encode
from molspark.session import materialize


def prepare_examples(
    df: DataFrame,
    key: str,
    label: str,
    smiles: str = "smiles",
    test_size: float = 0.2,
    seed: int = 42,
    tokens: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(examples, vocabulary): key, split, labels, input_ids and attention_mask per molecule.

    The label is renamed to ``labels``. The vocabulary is built from the train side. ``tokens``
    splits something else than SMILES.
    """
    tokens = smiles_tokens(F.col(smiles)) if tokens is None else tokens
    marked = train_test_split(df, key, test_size, seed)
    vocab = build_vocabulary(marked.filter(F.col("split") == "train"), tokens)
    labelled = rename_column(marked, label, "labels").withColumn("labels", F.col("labels").cast("double"))
    return encode(labelled, key, tokens, vocab, keep=("split", "labels")), vocab


def tune_hyperparameters(
    train: DataFrame,
    val: DataFrame,
    key: str,
    vector: str,
    label: str,
    n_trials: int = 20,
    seed: int = 42,
    max_train: int | None = None,
) -> tuple[dict, DataFrame]:
    """(best parameters, trials table) of a seeded random search whose trials share each pass over
    the rows. ``max_train`` bounds the rows that trials are fitted on; by default all take part."""
    trials = random_trials(train.sparkSession, n_trials, seed)
    results = materialize(sweep(trials, train, val, key, vector, label, max_train=max_train, seed=seed), "trials")
    best = best_trial(results).first()
    if best is None:
        raise ValueError("no trial finished with a finite value")
    return {name: best[name] for name in PARAMETERS}, results


@dataclass(frozen=True)
class Finetuned:
    head: Head
    params: HeadParams
    predictions: DataFrame
    report: DataFrame


def finetune_head(
    df: DataFrame,
    key: str,
    vector: str,
    label: str,
    n_trials: int = 0,
    params: HeadParams | None = None,
    seed: int = 42,
) -> Finetuned:
    """Split, optionally tune, fit, score and report the whole test side.

    As in the usual two-way recipe, the test side also chooses the trial and the epoch, so
    its report is optimistic; ``rows_in_both`` measures the reuse.
    """
    marked = train_test_split(df, key, seed=seed)
    train, test = (marked.filter(F.col("split") == side) for side in ("train", "test"))
    params = params or HeadParams(seed=seed)
    if n_trials:
        best, _ = tune_hyperparameters(train, test, key, vector, label, n_trials, seed)
        params = replace(params, **best)
    head = fit_head(train, key, vector, label, params, val=test)
    predictions = test.withColumn("y_pred", score(vector, head)).withColumnRenamed(label, "y")
    return Finetuned(head, params, predictions, regression_report(predictions))


def line_report(
    df: DataFrame, key: str | list[str], x: Column, y: Column, by: str | None = None, seed: int = 42
) -> DataFrame:
    """Split, fit y = a x + b on the train side, score the test side and report the errors.

    Without a line (no train rows, or a constant x) predictions and errors are null.
    The table itself is never shuffled: the split boundary and the line come from small
    aggregates, and scoring and reporting are one scan with partial aggregation.
    """
    table = df.select(
        *([key] if isinstance(key, str) else key), *([by] if by else []), x.alias("x"), y.alias("y")
    )
    marked = train_test_split(table, key, seed=seed)
    slope, intercept = fit_line(marked.filter(F.col("split") == "train"), "x", "y")
    fitted = F.lit(None).cast("double") if slope is None else linear([F.col("x")], [slope], intercept)
    scored = marked.filter(F.col("split") == "test").withColumn("y_pred", fitted)
    return regression_report_by(scored, by, total=True) if by else regression_report(scored)
