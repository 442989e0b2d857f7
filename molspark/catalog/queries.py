"""The registered queries: (spark, folder of the tables) to DataFrame."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molspark.catalog import views as V
from molspark.functions import smiles as S
from molspark.functions.vectors import dot, linear
from molspark.functions.vectors import pool_first as first_token
from molspark.operators import checks, density_ratio, graphs, grouped_split, heads, joins, molecules, packing, ranking, reports, search, splits, trends, vocab
from molspark.operators.heads import HeadParams
from molspark.plans.finetune import line_report, prepare_examples
from molspark.session import scratch_path, ship_package
from molspark.sources import artifacts, tables

Query = Callable[[SparkSession, str], DataFrame]

_REGISTERED: dict[str, Query] = {}

SPLIT_SEED = 42
BATCH_SIZE = 32
MAX_LENGTH = 512
PACK_TOKENS = 128


def register(fn: Query) -> Query:
    _REGISTERED[fn.__name__] = fn
    return fn


def _shipped(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def all_queries() -> dict[str, Query]:
    return {name: _shipped(query) for name, query in _REGISTERED.items()}


def _split_molecules(spark: SparkSession, sf: str) -> DataFrame:
    return splits.train_test_split(V.molecules(spark, sf), "mol_id", 0.2, SPLIT_SEED)


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Scans, sources and sinks


@register
def csv_scan(spark, sf):
    rows = V.molecules(spark, sf).select(
        "mol_id",
        "smiles",
        F.when(F.col("carbons") == 13, F.lit("n/a")).otherwise(F.col("label").cast("string")).alias("label"),
    )
    path = scratch_path(spark, "csv_scan")
    tables.write_csv(rows, path)
    scanned = tables.read_csv(spark, path, "mol_id bigint, smiles string, label double")
    return scanned.select(
        "mol_id",
        "smiles",
        F.round("label", 4).alias("label"),
        F.col(tables.CORRUPT).isNotNull().alias("corrupt"),
    )


def _dirty_csv(spark, sf):
    label = F.when(F.col("carbons") == 13, F.lit("n/a")).otherwise(F.col("label").cast("string"))
    path = scratch_path(spark, "csv")
    tables.write_csv(V.molecules(spark, sf).select("mol_id", "smiles", label.alias("label")), path)
    return tables.split_corrupt(tables.read_csv(spark, path, "mol_id bigint, smiles string, label double"))


@register
def csv_accepted(spark, sf):
    return _dirty_csv(spark, sf)[0].select("smiles")


@register
def csv_counts(spark, sf):
    good, bad = _dirty_csv(spark, sf)
    return good.agg(F.count("*").alias("n_good")).withColumn("n_bad", bad.agg(F.count("*")).scalar())


@register
def series_generate(spark, sf):
    parts = V.table(spark, sf, "part").select(F.col("p_partkey").alias("mol_id"), "p_size")
    labels = F.sequence(F.lit(2), F.greatest(F.col("p_size").cast("int"), F.lit(2)), F.lit(2))
    return molecules.expand_series(parts, labels).drop("p_size")


@register
def series_union(spark, sf):
    parts = V.table(spark, sf, "part").select(F.col("p_partkey").alias("mol_id"), "p_size")
    alkenes = molecules.series_of(parts, F.col("p_size"), "Alkene")
    alcohols = molecules.series_of(parts, F.col("p_size"), "Alcohol", compat=False)
    return alkenes.unionByName(alcohols).drop("p_size")


@register
def dataset_profile(spark, sf):
    return reports.dataset_profile(V.doc_labels(spark, sf), ["doc_id", "n_chars", "quality", "lang", "source"], exact=True)


@register
def dataset_preview(spark, sf):
    return reports.preview(V.molecules(spark, sf), "mol_id", 5)


@register
def score_roundtrip(spark, sf):
    path = scratch_path(spark, "score_roundtrip")
    tables.write_predictions(V.property_values(spark, sf).select("mol_id", "property", "value"), path)
    return tables.read_predictions(spark, path, "mol_id bigint, value double, property string")


@register
def head_roundtrip(spark, sf):
    rows = V.planted(spark, sf)
    path = scratch_path(spark, "head_roundtrip")
    artifacts.save_head(spark, heads.fit_linear_head(rows, "embedding", "target"), path)
    loaded = artifacts.load_head(spark, path)
    return rows.select("vec_id", F.round(heads.score("embedding", loaded), 4).alias("y_pred"))


# Projections and row transforms


@register
def rename_select(spark, sf):
    renamed = reports.rename_column(V.table(spark, sf, "lineitem"), "l_extendedprice", "labels")
    return reports.select_columns(renamed, [*V.LINE_KEY, "labels"])


@register
def validate_reasons(spark, sf):
    checked = molecules.validate(V.mixed_smiles(spark, sf))
    return checked.select(
        "mol_id", "smiles", F.array_join("reasons", ",").alias("reasons"), "verdict", "has_aromatic"
    )


@register
def validate_accept(spark, sf):
    return molecules.validation_report(molecules.validate(V.mixed_smiles(spark, sf)))


@register
def aromatic_audit(spark, sf):
    audit = molecules.aromatic_audit(V.mixed_smiles(spark, sf), "source")
    return _rounded(audit, 9, "share")


@register
def example_atoms(spark, sf):
    atoms = graphs.atom_table(graphs.with_graph(tables.spread(V.mixed_smiles(spark, sf))), "mol_id")
    return atoms.select("mol_id", "atom", "symbol", "aromatic", "charge", "degree", "orders", "hydrogens", "fragment")


@register
def example_bonds(spark, sf):
    bonds = graphs.bond_table(graphs.with_graph(tables.spread(V.mixed_smiles(spark, sf))), "mol_id")
    return bonds.groupBy("mol_id").agg(
        F.count("*").alias("n_bonds"), F.count_if("aromatic").alias("n_aromatic"), F.count_if(F.col("order") == 2).alias("n_double"),
        F.min("a").alias("least"), F.max("b").alias("most"),
    )


@register
def chain_atoms(spark, sf):
    atoms = graphs.atom_table(graphs.with_graph(tables.spread(V.molecules(spark, sf))), "mol_id")
    return atoms.select("mol_id", "atom", "symbol", "degree", "orders", "hydrogens", "fragment", "fits")


@register
def chain_bonds(spark, sf):
    return graphs.bond_table(graphs.with_graph(tables.spread(V.molecules(spark, sf))), "mol_id")


@register
def chemical_verdicts(spark, sf):
    gated = graphs.chemical_gate(tables.spread(V.ended_chains(spark, sf)))
    return gated.select("mol_id", "smiles", F.array_join("reasons", ",").alias("reasons"))


@register
def molecule_composition(spark, sf):
    found = graphs.composition(graphs.with_graph(tables.spread(V.ended_chains(spark, sf))))
    return found.select("mol_id", "formula", "n_atoms", "n_bonds", "n_fragments", "n_rings", "n_hydrogens", "charge")


@register
def element_counts(spark, sf):
    return graphs.element_table(graphs.with_graph(tables.spread(V.ended_chains(spark, sf))), "source")


@register
def kekulize(spark, sf):
    rows = graphs.kekulize(tables.spread(V.aromatic_molecules(spark, sf)))
    again = graphs.composition(graphs.with_graph(rows.drop("fault"), "kekule"))
    return again.select(
        "mol_id", F.col("kekule").isNotNull().alias("accepted"), F.coalesce(F.regexp_count("kekule", F.lit("=")), F.lit(0)).alias("n_double"),
        F.coalesce(F.regexp_count("kekule", F.lit("[a-z]")), F.lit(0)).alias("n_lower"), F.coalesce("formula", F.lit("")).alias("formula"),
    )


@register
def tokenize(spark, sf):
    tokens = S.smiles_tokens(F.col("smiles"))
    return V.mixed_smiles(spark, sf).select("mol_id", F.posexplode(tokens).alias("pos", "token"))


@register
def vocab_build(spark, sf):
    return vocab.build_vocabulary(V.mixed_smiles(spark, sf), S.smiles_tokens(F.col("smiles")))


@register
def vocab_documents(spark, sf):
    return vocab.build_vocabulary(V.documents(spark, sf), S.word_tokens(F.col("text")))


@register
def encode(spark, sf):
    rows, tokens = V.mixed_smiles(spark, sf), S.smiles_tokens(F.col("smiles"))
    encoded = vocab.encode(rows, "mol_id", tokens, vocab.build_vocabulary(rows, tokens))
    # No row is empty; the outer form keeps the optimizer from testing that with a second lookup.
    return encoded.select("mol_id", F.posexplode_outer("input_ids").alias("pos", "id"))


def _encoded_documents(spark, sf):
    rows, tokens = V.documents(spark, sf), S.word_tokens(F.col("text"))
    vocabulary = vocab.build_vocabulary(rows, tokens)
    return vocab.encode(rows, "doc_id", tokens, vocabulary)


@register
def encode_documents(spark, sf):
    encoded = _encoded_documents(spark, sf)
    return encoded.select(
        "doc_id",
        F.size("input_ids").alias("n_tokens"),
        F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("digest"),
    )


@register
def encode_roundtrip(spark, sf):
    rows, tokens = V.mixed_smiles(spark, sf), S.smiles_tokens(F.col("smiles"))
    vocabulary = vocab.build_vocabulary(rows, tokens)
    encoded = vocab.encode(rows, "mol_id", tokens, vocabulary)
    decoded = vocab.decode(F.col("input_ids"), vocab.vocabulary_head(vocabulary))
    return encoded.select("mol_id", F.array_join(decoded, "").alias("smiles"))


@register
def decode_documents(spark, sf):
    rows, tokens = V.documents(spark, sf), S.word_tokens(F.col("text"))
    vocabulary = vocab.build_vocabulary(rows, tokens)
    encoded = vocab.encode(rows, "doc_id", tokens, vocabulary).select("doc_id", "input_ids")
    decoded = vocab.decode_rows(encoded, vocabulary)
    return decoded.select("doc_id", F.array_join("tokens", " ").alias("words"))


@register
def prepare_documents(spark, sf):
    """The whole preparation path; tokens that only the test side has are unknown."""
    rows = tables.spread(V.table(spark, sf, "documents").select("doc_id", "text", "n_chars"), V.DOCUMENTS_A_TASK)
    examples, _ = prepare_examples(rows, "doc_id", "n_chars", seed=SPLIT_SEED, tokens=S.word_tokens(F.col("text")))
    return examples.select(
        "doc_id",
        "split",
        "labels",
        F.size("input_ids").alias("n_tokens"),
        F.size(F.filter("input_ids", lambda i: i == vocab.UNK)).alias("n_unknown"),
        F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("digest"),
    )


@register
def saved_vocabulary(spark, sf):
    rows, tokens = V.mixed_smiles(spark, sf), S.smiles_tokens(F.col("smiles"))
    path = scratch_path(spark, "vocabulary")
    artifacts.save_vocabulary(vocab.build_vocabulary(rows, tokens), path)
    encoded = vocab.encode(rows, "mol_id", tokens, artifacts.load_vocabulary(spark, path))
    return encoded.select("mol_id", F.posexplode_outer("input_ids").alias("pos", "id"))


@register
def pad_fixed(spark, sf):
    padded = vocab.pad_fixed(_encoded_documents(spark, sf), MAX_LENGTH)
    return padded.select(
        "doc_id",
        "n_tokens",
        F.size("input_ids").alias("padded"),
        F.size(F.filter("attention_mask", lambda m: m == 0)).alias("n_pad"),
        "overflow",
    )


def _padded_batches(spark, sf):
    rows, tokens = V.mixed_smiles(spark, sf), S.smiles_tokens(F.col("smiles"))
    encoded = vocab.encode(rows, "mol_id", tokens, vocab.build_vocabulary(rows, tokens))
    return vocab.pad_batches(splits.assign_batches(encoded, "mol_id", BATCH_SIZE, SPLIT_SEED))


@register
def pad_batch(spark, sf):
    padded = _padded_batches(spark, sf)
    return padded.select(
        "mol_id",
        "batch_id",
        "n_tokens",
        "width",
        F.size("input_ids").alias("padded"),
        F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m).alias("n_real"),
    )


@register
def pad_waste(spark, sf):
    return _rounded(vocab.padding_waste(_padded_batches(spark, sf)), 9, "waste")


def _packed(spark, sf):
    rows = V.mixed_smiles(spark, sf)
    sized = rows.select("mol_id", (F.size(S.smiles_tokens(F.col("smiles"))) + 1).alias("n_tokens"))
    return packing.pack_sequences(sized, "mol_id", "n_tokens", PACK_TOKENS, SPLIT_SEED)


@register
def pack_waste(spark, sf):
    return _rounded(packing.packing_waste(_packed(spark, sf), "n_tokens", PACK_TOKENS), 9, "waste")


@register
def pack_check(spark, sf):
    return packing.packing_check(_packed(spark, sf), "n_tokens", PACK_TOKENS)


@register
def batch_assign(spark, sf):
    rows = V.predictions(spark, sf).select("row_key")
    return splits.assign_batches(rows, "row_key", BATCH_SIZE, SPLIT_SEED)


@register
def unwrap_prediction(spark, sf):
    raw = V.property_values(spark, sf).select(
        "mol_id",
        F.create_map("property", F.struct("value")).alias("pred"),
    )
    return trends.unwrap_prediction(raw, "pred")


@register
def pool_first(spark, sf):
    hidden = V.table(spark, sf, "embeddings").select(
        "vec_id", F.array("embedding", F.reverse("embedding")).alias("hidden")
    )
    pooled = hidden.select("vec_id", F.posexplode(first_token(F.col("hidden"))).alias("pos", "x"))
    return pooled.select("vec_id", "pos", F.col("x").cast("double").alias("x"))


@register
def parity_table(spark, sf):
    return _rounded(reports.parity_table(V.predictions(spark, sf), "row_key"), 4, "actual", "predicted", "residual")


@register
def parity_hist(spark, sf):
    return _rounded(reports.parity_histogram(V.predictions(spark, sf), 50), 4, "mean_residual")


# Filters


@register
def mse_nullable(spark, sf):
    scored = V.doc_labels(spark, sf).withColumn("y_pred", linear([F.col("n_chars")], [0.0001], 0.25))
    return _rounded(reports.masked_loss(scored, "quality", "y_pred"), 9, "mse")


@register
def split_exact(spark, sf):
    return _split_molecules(spark, sf).select("mol_id", "split")


@register
def split_exact_lines(spark, sf):
    rows = V.predictions(spark, sf).select("row_key")
    return splits.train_test_split(rows, "row_key", 0.2, SPLIT_SEED)


@register
def split_hash(spark, sf):
    rows = V.predictions(spark, sf).select("row_key")
    return splits.threshold_split(rows, "row_key", 0.2, SPLIT_SEED)


# Joins


@register
def score_cross(spark, sf):
    return V.property_values(spark, sf)


@register
def pred_label_join(spark, sf):
    events = V.table(spark, sf, "events")
    scored = events.select("event_id", linear([F.col("value")], [0.9], 5.0).alias("y_pred"))
    labels = events.select("event_id", F.col("value").alias("y"))
    return _rounded(joins.join_one_to_one(scored, labels, "event_id"), 4, "y_pred")


@register
def pred_attr_join(spark, sf):
    values = V.property_values(spark, sf).select("mol_id", "property", "value")
    attributes = V.molecules(spark, sf).select("mol_id", "family", "carbons")
    return values.join(attributes, "mol_id")


@register
def family_compare(spark, sf):
    compared = trends.family_compare(V.property_values(spark, sf), digits=8)
    return _rounded(compared, 8, "delta")


@register
def family_compare_counted(spark, sf):
    values = V.property_values(spark, sf)
    n = F.when(F.col("family") == "alkene", S.alkene_smiles(F.col("carbons"))).otherwise(
        S.alcohol_smiles(F.col("carbons"))
    )
    compared = trends.family_compare(values.withColumn("carbon_count", S.carbon_count(n)), "carbon_count", digits=8)
    return _rounded(compared, 8, "delta")


@register
def property_order(spark, sf):
    wide = trends.property_order(V.property_values(spark, sf), "mol_id")
    return wide.select(
        "mol_id",
        F.col("`Melting Point`").alias("melting"),
        F.col("`Flash Point`").alias("flash"),
        F.col("`Boiling Point`").alias("boiling"),
        "ordered",
    )


def _linked_documents(spark, sf):
    """Documents that share a text, its beginning, or a source and a length are linked."""
    docs = V.table(spark, sf, "documents").select("doc_id", "text", "source", "n_chars")
    head = F.lower(F.substring("text", 1, 24))
    return docs, [head, F.col("text"), F.concat_ws(":", "source", "n_chars")]


@register
def linked_documents(spark, sf):
    docs, values = _linked_documents(spark, sf)
    return grouped_split.linked_groups(docs, "doc_id", values).select("doc_id", "group_id", "group_rows")


@register
def split_by_groups(spark, sf):
    docs, values = _linked_documents(spark, sf)
    parted = grouped_split.grouped_split(docs, "doc_id", values, 0.2, SPLIT_SEED)
    sides = parted.agg(F.count("*").alias("n_rows"), F.count_if(F.col("split") == "test").alias("n_test"))
    shared = [
        parted.where(value.isNotNull()).groupBy(value.alias("v")).agg(F.count_distinct("split").alias("sides")).agg(F.count_if(F.col("sides") > 1).alias(f"shared_{i}"))
        for i, value in enumerate(values)
    ]
    for one in shared:
        sides = sides.crossJoin(one)  # tables of one row
    return sides


@register
def split_overlap(spark, sf):
    return checks.split_overlap(_split_molecules(spark, sf), F.trim("smiles"))


@register
def split_shared_values(spark, sf):
    return checks.shared_values(_split_molecules(spark, sf), "smiles")


@register
def split_three(spark, sf):
    rows = V.predictions(spark, sf).select("row_key")
    return splits.three_way_split(rows, "row_key", 0.1, 0.2, SPLIT_SEED)


@register
def split_reuse(spark, sf):
    rows = V.predictions(spark, sf).select("row_key")
    test = splits.train_test_split(rows, "row_key", 0.2, SPLIT_SEED).filter("split = 'test'")
    tuning = ranking.head_by_hash(test, "row_key", 1000, SPLIT_SEED)
    return checks.rows_in_both(tuning, test, "row_key")


# Aggregations


@register
def regression_report(spark, sf):
    report = reports.regression_report(V.predictions(spark, sf))
    return _rounded(_rounded(report, 4, "mae", "rmse", "r2"), 2, "mse")


@register
def regression_report_by(spark, sf):
    report = reports.regression_report_by(V.predictions(spark, sf), "grp", total=True)
    return _rounded(_rounded(report, 4, "mae", "rmse", "r2"), 2, "mse")


@register
def epoch_loss(spark, sf):
    losses = reports.epoch_losses(V.errors(spark, sf), "run", "epoch", "sq_err")
    return _rounded(losses, 7, "eval_loss")


@register
def best_trial(spark, sf):
    return search.best_trial(V.trials(spark, sf), by="study")


# Windows


@register
def trend_check(spark, sf):
    checked = trends.trend_check(trends.trend_table(V.property_values(spark, sf)))
    return _rounded(checked, 6, "slope")


@register
def best_so_far(spark, sf):
    return _rounded(search.best_so_far(V.trials(spark, sf)), 9, "log10_best")


@register
def checkpoint_retention(spark, sf):
    losses = reports.epoch_losses(V.errors(spark, sf), "run", "epoch", "sq_err").drop("n")
    return search.checkpoint_retention(_rounded(losses, 7, "eval_loss"))


@register
def global_rank(spark, sf):
    return ranking.hash_rank(V.predictions(spark, sf).select("row_key"), "row_key", SPLIT_SEED)


@register
def sorted_rank(spark, sf):
    rows = V.predictions(spark, sf).select("row_key", F.round("y", 2).alias("y"))
    return ranking.sorted_rank(rows, [F.col("y").desc(), F.col("row_key")])


# Limits and sampling


@register
def head_n(spark, sf):
    rows = V.predictions(spark, sf).select("row_key", F.round("y", 4).alias("y"))
    return ranking.head_by_hash(rows, "row_key", 5000, SPLIT_SEED)


@register
def trial_topk(spark, sf):
    return search.leaderboard(V.trials(spark, sf), 10)


@register
def trial_topk_by_study(spark, sf):
    return search.leaderboard(V.trials(spark, sf), 5, by="study")


# Set operations


@register
def split_partition_check(spark, sf):
    rows = V.predictions(spark, sf).select("row_key")
    parts = splits.train_test_split(rows, "row_key", 0.2, SPLIT_SEED)
    return checks.split_partition_check(rows, parts, "row_key")


# Search tables


def _drawn_trials(spark, sf):
    ids = V.table(spark, sf, "events").select((F.col("user_id") % 20).alias("study"), F.col("event_id").alias("trial_id"))
    return search.draw_parameters(ids, ["study", "trial_id"], SPLIT_SEED)


@register
def search_space(spark, sf):
    return _rounded(_drawn_trials(spark, sf), 12, "dropout", "learning_rate")


def _valued_trials(spark, sf):
    return search.draw_parameters(V.trials(spark, sf), ["study", "trial_id"], SPLIT_SEED)


@register
def trial_densities(spark, sf):
    return density_ratio.densities(_valued_trials(spark, sf))


@register
def next_trials(spark, sf):
    proposed = density_ratio.propose(_valued_trials(spark, sf), n_next=3, seed=SPLIT_SEED)
    return _rounded(_rounded(proposed, 12, "dropout", "learning_rate"), 6, "score")


@register
def trials_tall(spark, sf):
    tall = search.trials_tall(_drawn_trials(spark, sf), "trial_id", list(search.PARAMETERS))
    return _rounded(tall, 9, "value", "scaled")


# Trend tables and quality checks


@register
def trend_table(spark, sf):
    return _rounded(trends.trend_table(V.property_values(spark, sf)), 8, "mean_value")


@register
def key_unique(spark, sf):
    return checks.duplicate_keys(V.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register
def copy_number(spark, sf):
    rows = V.table(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    numbered = ranking.number_copies(rows, "l_returnflag")
    # Every pair is distinct, so distinct pairs are counted in tasks that follow the rows.
    numbered = numbered.repartition(ranking.copy_tasks(rows), "l_returnflag", "copy")
    return numbered.groupBy("l_returnflag").agg(
        F.count("*").alias("n_rows"), F.count_distinct("copy").alias("n_copies"), F.max("copy").alias("last_copy")
    )


@register
def carbon_mismatch(spark, sf):
    found = molecules.carbon_mismatch(V.molecules(spark, sf))
    return found.select("mol_id", "family", "carbons", "smiles", "carbon_count")


# Model jobs


@register
def finetune_report(spark, sf):
    rows = V.table(spark, sf, "lineitem")
    report = line_report(
        rows, V.LINE_KEY, F.col("l_quantity"), F.col("l_extendedprice"), by="l_returnflag", seed=SPLIT_SEED
    )
    return _rounded(_rounded(report, 4, "mae", "rmse", "r2"), 2, "mse")


@register
def fit_linear_1d(spark, sf):
    return _rounded(heads.fit_lines(V.predictions(spark, sf), "y_pred", "y", "grp"), 6, "slope", "intercept")


@register
def score_linear(spark, sf):
    rows = V.table(spark, sf, "embeddings")
    return rows.select("vec_id", F.round(dot(F.col("embedding"), range(1, 65), 0.5), 6).alias("y_pred"))


@register
def fit_head(spark, sf):
    head = heads.fit_head(
        V.planted(spark, sf), "vec_id", "embedding", "target",
        HeadParams(num_hidden_layers=1, dropout=0.0, learning_rate=0.02, batch_size=16, epochs=5),
    )
    losses = [(i, loss) for i, loss in enumerate(head.history)]
    return spark.createDataFrame(losses, "epoch int, loss double")


@register
def score_head(spark, sf):
    rows = V.planted(spark, sf)
    params = HeadParams(num_hidden_layers=2, dropout=0.1, learning_rate=0.01, batch_size=None, epochs=3)
    head = heads.fit_head(rows, "vec_id", "embedding", "target", params)
    return rows.select("vec_id", "target", heads.score("embedding", head).alias("y_pred"))


@register
def score_many_heads(spark, sf):
    rows = V.planted(spark, sf)
    doubled = rows.withColumn("target", F.col("target") * 2)
    fitted = {
        "single": heads.fit_linear_head(rows, "embedding", "target"),
        "double": heads.fit_linear_head(doubled, "embedding", "target"),
    }
    scored = heads.score_properties(rows.select("vec_id", "embedding"), "embedding", fitted)
    return scored.select("vec_id", "property", F.round("value", 4).alias("value"))


@register
def sweep(spark, sf):
    rows = splits.train_test_split(V.planted(spark, sf), "vec_id", 0.2, SPLIT_SEED)
    train, test = (rows.filter(F.col("split") == side) for side in ("train", "test"))
    return heads.sweep(search.random_trials(spark, 5, SPLIT_SEED), train, test, "vec_id", "embedding", "target")


@register
def sweep_objective(spark, sf):
    """A user objective over the whole validation side, for trials numbered from 0."""
    rows = splits.train_test_split(V.planted(spark, sf), "vec_id", 0.2, SPLIT_SEED)
    train, test = (rows.filter(F.col("split") == side) for side in ("train", "test"))
    trials = spark.range(5).select(F.col("id").alias("trial_id"))
    loss = lambda trial, x, y: (y - trial["trial_id"]) ** 2
    found = heads.sweep(trials, train, test, "vec_id", "embedding", "target", objective=loss)
    return _rounded(found, 4, "value")


@register
def score_hidden(spark, sf):
    """Two hidden layers whose inputs lie far from zero, where GELU is the identity or zero: the
    first adds 100, the second passes on every other unit."""
    dim = 64
    eye, even = np.eye(dim).ravel(), np.where(np.arange(dim) % 2 == 0, 0.0, -1000.0)
    weights = np.concatenate([eye, np.full(dim, 100.0), eye, even, np.arange(1.0, dim + 1), [0.5]])
    rows = V.table(spark, sf, "embeddings")
    scored = heads.score(F.col("embedding"), heads.Head(dim, 2, weights))
    return rows.select("vec_id", F.round(scored, 4).alias("y_pred"))


class _Lengths:
    """A model with the interface of the prediction services: a list in, maps of properties out."""

    def predict(self, smiles: list[str]) -> list[dict]:
        return [{"length": {"value": float(len(s))}} for s in smiles]


@register
def predict_map(spark, sf):
    rows = V.mixed_smiles(spark, sf).select("mol_id", "smiles")
    return heads.score_with(rows, heads.MapPredictor(_Lengths()), ["smiles"]).drop("smiles")
