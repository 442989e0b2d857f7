"""Vocabulary building, encoding, decoding and padding of token arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molspark.operators.ranking import sorted_rank
from molspark.session import materialize

# Special tokens take the first ids, in this order.
PAD, UNK, CLS = 0, 1, 2
SPECIALS = {"[PAD]": PAD, "[UNK]": UNK, "[CLS]": CLS}
FIRST_ID = len(SPECIALS)

# Encoding keeps at most this many (the most frequent) tokens, and this many characters
# of them, in task memory. Rarer tokens are looked up with a join.
HEAD_TOKENS = 50_000
HEAD_CHARACTERS = 4_000_000
# A vocabulary of up to this many tokens is a literal in the plan. Its map is scanned in id
# order, so frequent tokens are found first.
LITERAL_TOKENS = 256


def token_counts(df: DataFrame, tokens: Column) -> DataFrame:
    """(token, n): frequencies, combined per task so a hot token shuffles one row per task."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def build_vocabulary(df: DataFrame, tokens: Column) -> DataFrame:
    """(token, n, id): ids by falling frequency, then token, after the special ids.

    The ranking writes the table to the shared folder, so later lookups do not recount.
    """
    ranked = sorted_rank(token_counts(df, tokens), [F.col("n").desc(), F.col("token")], name="_rank")
    return ranked.select("token", "n", (F.col("_rank") - 1 + FIRST_ID).cast("int").alias("id"))


@dataclass(frozen=True)
class VocabularyHead:
    """The first tokens in id order with their ids, bounded by count and by characters."""

    tokens: tuple[str, ...]
    ids: tuple[int, ...]
    complete: bool


def vocabulary_head(
    vocab: DataFrame, max_tokens: int = HEAD_TOKENS, max_characters: int = HEAD_CHARACTERS
) -> VocabularyHead:
    """Fetch the head of a vocabulary: its first tokens by id, whatever the ids are."""
    size = F.sum(F.length("token")).over(
        Window.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # One row more than wanted, and null for what does not fit, tell whether this is all.
    first = vocab.select("id", "token").orderBy("id").limit(max_tokens + 1)
    place = F.row_number().over(Window.orderBy("id"))
    fits = (size <= max_characters) & (place <= max_tokens)
    rows = first.select("id", F.when(fits, F.col("token")).alias("token")).toArrow().sort_by("id")
    kept = rows.filter(rows.column("token").is_valid())
    return VocabularyHead(
        tuple(kept.column("token").to_pylist()), tuple(kept.column("id").to_pylist()), kept.num_rows == rows.num_rows
    )


def _literal_ids(tokens: Column, head: VocabularyHead) -> Column:
    if not head.tokens:
        return F.transform(tokens, lambda t: F.lit(UNK))
    ids = F.array(*[F.lit(i) for i in head.ids])
    known = F.map_from_arrays(F.array(*[F.lit(t) for t in head.tokens]), ids)
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), F.lit(UNK)))


def _lists(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("int64")


def _token_ids(tokens: pa.Array, head: VocabularyHead) -> pa.Array:
    index = pc.index_in(tokens.flatten().cast(pa.string()), value_set=pa.array(head.tokens, pa.string()))
    return pa.array(head.ids, pa.int32()).take(index)


def _resolve_all(head: VocabularyHead):
    """Arrow function: token lists to id lists, one hash lookup per batch of lists."""

    def resolve(tokens: pa.Array) -> pa.Array:
        ids = pc.fill_null(_token_ids(tokens, head), pa.scalar(UNK, pa.int32()))
        return _lists(ids, _lengths(tokens))

    return F.arrow_udf(resolve, "array<int>")


def _open_positions(found: pa.Array, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Where values of all lists are null, their positions in their lists, and their number by list.
    Apart from one flag a value, only the open ones take memory."""
    open_at = np.flatnonzero(pc.is_null(found).to_numpy(zero_copy_only=False))
    ends = np.cumsum(lengths)
    owner = np.searchsorted(ends, open_at, "right")
    positions = pa.array((open_at - (ends - lengths)[owner]).astype("int32"))
    return open_at, positions, np.bincount(owner, minlength=len(lengths))


def _resolve_head(head: VocabularyHead):
    """The same, but tokens outside the head are returned with their positions."""

    def resolve(tokens: pa.Array) -> pa.Array:
        ids = _token_ids(tokens, head)
        open_at, positions, gaps = _open_positions(ids, _lengths(tokens))
        words = tokens.flatten().take(pa.array(open_at))
        return pa.StructArray.from_arrays(
            [_lists(ids, _lengths(tokens)), _lists(positions, gaps), _lists(words, gaps)],
            names=["_ids", "_pos", "_token"],
        )

    return F.arrow_udf(resolve, "_ids array<int>, _pos array<int>, _token array<string>")


def _fill_gaps(ids: pa.Array, pos: pa.Array, found: pa.Array) -> pa.Array:
    """Write the ids found for open positions into the id lists; the rest become ``UNK``."""
    lengths = _lengths(ids)
    starts = np.cumsum(lengths) - lengths
    flat = pc.fill_null(ids.flatten(), pa.scalar(UNK, pa.int32())).to_numpy(zero_copy_only=False).copy()
    flat[np.repeat(starts, _lengths(pos)) + pos.flatten().to_numpy()] = found.flatten().to_numpy()
    return _lists(pa.array(flat), lengths)


def encode(
    df: DataFrame,
    key: str,
    tokens: Column,
    vocab: DataFrame,
    add_cls: bool = True,
    max_tokens: int = HEAD_TOKENS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(key, kept columns, input_ids, attention_mask): ids per row, unknown tokens as ``UNK``.

    Frequent tokens are resolved inside the row: by a plan literal for a small vocabulary,
    else by one Arrow lookup. If the vocabulary does not fit the bounds
    above, only the positions left open are exploded and joined with the rest of the
    vocabulary; those tokens are rare by construction, so that join has no hot key.
    ``key`` is only passed on and may repeat or be null. Row positions start with a ``CLS`` id when ``add_cls``.
    """
    head = vocabulary_head(vocab, max_tokens)
    if head.complete:
        present = F.coalesce(tokens, _no_strings())
        small = len(head.tokens) <= LITERAL_TOKENS
        ids = _literal_ids(present, head) if small else _resolve_all(head)(present)
        encoded = df.select(key, *keep, ids.alias("_ids"))
    else:
        encoded = _encode_with_tail(df, key, tokens, vocab, head, keep)
    if add_cls:
        ids = F.concat(F.array(F.lit(CLS)), F.col("_ids"))
        encoded = encoded.withColumn("_ids", ids)
    mask = F.array_repeat(F.lit(1), F.size("_ids"))
    return encoded.select(key, *keep, F.col("_ids").alias("input_ids"), mask.alias("attention_mask"))


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _encode_with_tail(
    df: DataFrame, key: str, tokens: Column, vocab: DataFrame, head: VocabularyHead, keep: tuple[str, ...]
) -> DataFrame:
    # Several branches read the lookup, so it is written once, with a number for each row.
    columns = [F.col(c) for c in dict.fromkeys((key, *keep))]
    looked = df.select(*columns, _resolve_head(head)(F.coalesce(tokens, _no_strings())).alias("_r"))
    resolved = materialize(looked.select(*columns, "_r.*", F.monotonically_increasing_id().alias("_row")), "encode")
    gaps = resolved.select("_row", F.explode(F.arrays_zip("_pos", "_token")).alias("_gap"))
    last = head.ids[-1] if head.ids else None
    rest = vocab if last is None else vocab.filter(F.col("id") > last)
    tail = rest.select(F.col("token").alias("_token"), F.col("id").alias("_id"))
    # Known tail tokens are rare; a frequent token outside the vocabulary finds no partner,
    # and its partition is one that adaptive execution splits.
    found = (
        gaps.select("_row", "_gap._pos", "_gap._token")
        .join(tail.hint("merge"), "_token")
        .groupBy("_row")
        .agg(F.collect_list(F.struct("_pos", "_id")).alias("_found"))
    )
    no_ints = F.array().cast("array<int>")
    filled = F.arrow_udf(_fill_gaps, "array<int>")(
        F.col("_ids"),
        F.coalesce(F.col("_found._pos"), no_ints),
        F.coalesce(F.col("_found._id"), no_ints),
    )
    is_open = F.size("_pos") > 0
    # Rows without a gap skip the join and its shuffle.
    whole = resolved.filter(~is_open).select(*columns, "_ids")
    joined = resolved.filter(is_open).join(found, "_row", "left")
    return whole.unionByName(joined.select(*columns, filled.alias("_ids")))


def decode(ids: Column, head: VocabularyHead) -> Column:
    """Tokens for ids of a vocabulary that fits in task memory; other ids are dropped if they are
    specials and null otherwise. :func:`decode_rows` takes a vocabulary of any size."""
    if not head.complete:
        raise ValueError("this vocabulary is too large to decode in task memory")
    plain = F.filter(F.coalesce(ids, F.array().cast("array<int>")), lambda i: i >= FIRST_ID)
    return _head_tokens(head)(plain)


def _head_tokens(head: VocabularyHead):
    def lookup(column: pa.Array) -> pa.Array:
        index = pc.index_in(column.flatten().cast(pa.int32()), value_set=pa.array(head.ids, pa.int32()))
        return _lists(pa.array(head.tokens, pa.string()).take(index), _lengths(column))

    return F.arrow_udf(lookup, "array<string>")


def decode_rows(
    df: DataFrame, vocab: DataFrame, ids: str = "input_ids", name: str = "tokens", max_tokens: int = HEAD_TOKENS
) -> DataFrame:
    """Add the tokens of ``ids`` without specials, for a vocabulary of any size.

    Tokens of the head are looked up in the row; only positions that stay open are joined with
    the rest of the vocabulary, and only rows that have such positions are shuffled. An id that the vocabulary lacks gives a null token.
    """
    head = vocabulary_head(vocab, max_tokens)
    plain = F.filter(F.coalesce(ids, F.array().cast("array<int>")), lambda i: i >= FIRST_ID)
    if head.complete:
        return df.withColumn("_plain", plain).withColumn(name, _head_tokens(head)("_plain")).drop("_plain")
    kept = [n for n in df.columns if n != name]
    looked = df.select(*df.columns, _look_up_head(head)(plain).alias("_r"))
    looked = looked.select(*kept, "_r.*", F.monotonically_increasing_id().alias("_row"))
    looked = materialize(looked, "decode")
    gaps = looked.select("_row", F.explode(F.arrays_zip("_pos", "_open")).alias("_gap"))
    last = head.ids[-1] if head.ids else None
    rest = vocab if last is None else vocab.filter(F.col("id") > last)
    tail = rest.select(F.col("id").alias("_open"), F.col("token").alias("_token"))
    found = gaps.select("_row", "_gap._pos", "_gap._open").join(tail.hint("merge"), "_open")
    found = found.groupBy("_row").agg(F.collect_list(F.struct("_pos", "_token")).alias("_found"))
    is_open = F.size("_pos") > 0
    no_ints, joined = F.array().cast("array<int>"), looked.where(is_open).join(found, "_row", "left")
    filled = F.arrow_udf(_fill_tokens, "array<string>")(
        F.col("_tokens"), F.coalesce(F.col("_found._pos"), no_ints), F.coalesce(F.col("_found._token"), _no_strings())
    )
    columns = [n if n != name else F.col("_tokens").alias(name) for n in dict.fromkeys((*df.columns, name))]
    rows = joined.withColumn("_tokens", filled).select(columns)
    return looked.where(~is_open).select(columns).unionByName(rows)


def _look_up_head(head: VocabularyHead):
    """Arrow function: ids to tokens, null where the head has none, and the positions and ids of those."""

    def look_up(ids: pa.Array) -> pa.Array:
        lengths, flat = _lengths(ids), ids.flatten().cast(pa.int32())
        index = pc.index_in(flat, value_set=pa.array(head.ids, pa.int32()))
        open_at, positions, gaps = _open_positions(index, lengths)
        tokens = pa.array(head.tokens, pa.string()).take(index)
        return pa.StructArray.from_arrays(
            [_lists(tokens, lengths), _lists(positions, gaps), _lists(flat.take(pa.array(open_at)), gaps)],
            names=["_tokens", "_pos", "_open"],
        )

    return F.arrow_udf(look_up, "_tokens array<string>, _pos array<int>, _open array<int>")


def _fill_tokens(tokens: pa.Array, pos: pa.Array, words: pa.Array) -> pa.Array:
    """Put the words found for open positions into the token lists; the rest stay null."""
    flat, found, lengths = tokens.flatten(), words.flatten(), _lengths(tokens)
    starts = np.cumsum(lengths) - lengths
    index = np.arange(len(flat))
    index[np.repeat(starts, _lengths(pos)) + pos.flatten().to_numpy()] = len(flat) + np.arange(len(found))
    return _lists(pa.concat_arrays([flat, found.cast(flat.type)]).take(pa.array(index)), lengths)


def _pad(array: Column, width: Column, filler: int) -> Column:
    return F.concat(array, F.array_repeat(F.lit(filler), F.greatest(width - F.size(array), F.lit(0))))


def pad_fixed(df: DataFrame, max_length: int = 512) -> DataFrame:
    """Pad ``input_ids`` and ``attention_mask`` to ``max_length``; longer rows stay whole.

    ``overflow`` marks rows that exceed the length.
    """
    width = F.lit(max_length)
    return df.withColumns(
        {
            "n_tokens": F.size("input_ids"),
            "overflow": F.size("input_ids") > max_length,
            "input_ids": _pad(F.col("input_ids"), width, PAD),
            "attention_mask": _pad(F.col("attention_mask"), width, 0),
        }
    )


def pad_batches(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Pad each row to the longest row of its batch; ``n_tokens`` and ``width`` are kept.

    A batch has a fixed small number of rows, so the window is bounded.
    """
    sized = df.withColumn("n_tokens", F.size("input_ids"))
    width = F.max("n_tokens").over(Window.partitionBy(batch))
    return sized.withColumn("width", width).withColumns(
        {
            "input_ids": _pad(F.col("input_ids"), F.col("width"), PAD),
            "attention_mask": _pad(F.col("attention_mask"), F.col("width"), 0),
        }
    )


def padding_waste(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Share of pad positions per batch of a padded table."""
    return df.groupBy(batch).agg(
        F.count("*").alias("n_rows"),
        F.max("width").alias("width"),
        (1 - F.sum("n_tokens") / F.sum("width")).alias("waste"),
    )
