"""Exact ranks and order statistics without moving a table into one task."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molspark.functions.hashing import as_columns, seeded_hash
from molspark.session import materialize

# Hex digits of the bounds between which an order statistic is expected.
_BAND_DIGITS = 12
# Digest prefix counted when it is elsewhere: at most 16**4 cells.
_PREFIX_DIGITS = 4
_DIGEST_DIGITS = 32
# monotonically_increasing_id keeps the row number of a partition in the low 33 bits.
_ROW_BITS = 33
_MAX_DIGITS = 5
_CELL_ROWS = 1_000_000
_COPY_SALTS = 65_536
_COPY_CHUNK = 100_000
# Rows that a task expands from counted copies, about.
_COPY_ROWS = 500_000


def _cell_digits(df: DataFrame) -> int:
    """Hex digits that give at least four cells per shuffle partition and cells of about
    ``_CELL_ROWS`` rows (16**2 to 16**5 cells)."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(4 * partitions, df.count() / _CELL_ROWS)
    digits = 2
    while 16**digits < wanted and digits < _MAX_DIGITS:
        digits += 1
    return digits


def hash_rank(df: DataFrame, key, seed: int = 42, name: str = "rank", digits: int | None = None) -> DataFrame:
    """Add the exact 1-based rank of each row in the order of its seeded hash.

    ``key`` must identify a row; :func:`number_copies` completes one that does not. Then
    digests are uniform and the cells (digest prefixes) have equal sizes. Two passes: one
    counts rows per cell from the key columns alone, one shuffles the rows by cell. What
    is broadcast is one row per cell, at most 16**5 whatever the table size.
    """
    digits = digits or _cell_digits(df)
    if digits > _MAX_DIGITS:
        raise ValueError(f"more than {_MAX_DIGITS} digits would broadcast too many offsets")
    digest = seeded_hash(key, seed)
    counts = df.groupBy(F.substring(digest, 1, digits).alias("_cell")).agg(F.count("*").alias("_n"))
    offsets = counts.select(
        "_cell", (F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).alias("_before")
    )
    in_cell = Window.partitionBy("_cell").orderBy("_digest", *as_columns(key))
    return (
        df.withColumn("_digest", digest)
        .withColumn("_cell", F.substring("_digest", 1, digits))
        .withColumn("_row", F.row_number().over(in_cell))
        .join(F.broadcast(offsets), "_cell")
        .withColumn(name, F.col("_before") + F.col("_row"))
        .drop("_cell", "_digest", "_row", "_before")
    )


def sorted_rank(df: DataFrame, order, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Add the exact 1-based rank of each row under any sort order.

    Range-partitions and sorts once, then writes the placed rows, because the partition
    sizes and the rows must come from the same layout even if executors are lost in
    between. The order should be total: equal sort keys go to one partition.
    """
    order = as_columns(order)
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = materialize(
        ranged.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "sorted_rank"
    )
    part = F.shiftright("_place", _ROW_BITS)
    local = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition of the sort.
    offsets = counts.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + local + 1)
        .drop("_part", "_place", "_before")
    )


@dataclass(frozen=True)
class Cutoff:
    """The ``k``-th smallest digest of a table: a row is within if its digest is not larger."""

    key: tuple[str, ...]
    seed: int | str
    k: int
    n_rows: int
    digest: str | None

    def contains(self) -> Column:
        if self.digest is None:
            return F.lit(False)
        return seeded_hash(list(self.key), self.seed) <= F.lit(self.digest)


def hash_cutoff(df: DataFrame, key, k, seed: int | str = 42) -> Cutoff:
    """Find the ``k``-th smallest seeded hash; ``k`` is a number or a function of the row count.

    Digests are uniform, so the boundary is expected near the k / n quantile. One pass
    counts the digests below a narrow band around it and, one by one, those inside (about
    sqrt(n)); the row count itself comes from file metadata where the source has it. If the
    boundary is not in the band, as with keys that fill much of the table, a histogram of
    digest prefixes finds it in two passes. Only key columns are read, one row returns to
    the driver, and selecting rows with the result is a plain filter: no row of the table
    is ever shuffled or sorted. Rows with equal keys fall on the same side; sizes are exact
    when the key is unique.
    """
    names = (key,) if isinstance(key, str) else tuple(key)
    digests = df.select(seeded_hash(list(names), seed).alias("_digest"))
    n_rows = df.count()
    target = min(int(k(n_rows) if callable(k) else k), n_rows)
    if target <= 0:
        return Cutoff(names, seed, 0, n_rows, None)
    low, high = _band(target, n_rows)
    digest = _locate(digests, target, low, high) or _locate_by_prefix(digests, target)
    return Cutoff(names, seed, target, n_rows, digest)


def _band(target: int, n_rows: int) -> tuple[str, str]:
    """Hex bounds that hold the ``target``-th of ``n_rows`` uniform digests almost surely."""
    q = target / n_rows
    margin = 6 * math.sqrt(q * (1 - q) / n_rows) + 12 / n_rows
    low, high = max(q - margin, 0.0), q + margin
    top = 16**_BAND_DIGITS
    # "g" sorts after every hex digit.
    return f"{int(low * top):0{_BAND_DIGITS}x}", "g" if high >= 1 else f"{int(high * top):0{_BAND_DIGITS}x}"


def _running(frame: DataFrame, cell: Column) -> DataFrame:
    counts = frame.groupBy(cell.alias("_cell")).agg(F.count("*").alias("_n"))
    return counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_cell")))


def _locate(digests: DataFrame, target: int, low: str, high: str) -> str | None:
    """The ``target``-th digest if it lies in [low, high), else None."""
    digest = F.col("_digest")
    # All digests below and all above count as one cell each; "g" sorts last.
    cell = F.when(digest < low, "").when(digest < high, digest).otherwise("g")
    upto = _running(digests, cell).filter(F.col("_upto") >= target)
    found = upto.agg(F.min("_cell")).first()[0]
    return None if found in ("", "g") else found


def _locate_by_prefix(digests: DataFrame, target: int) -> str:
    """The ``target``-th digest, whatever the distribution of the keys: each pass counts the next
    digits below the prefix found so far, at most 16**4 cells, until the digest is whole."""
    prefix, below = "", 0
    while len(prefix) < _DIGEST_DIGITS:
        inside = digests.filter(F.startswith("_digest", F.lit(prefix))) if prefix else digests
        cells = _running(inside, F.substring("_digest", 1, len(prefix) + _PREFIX_DIGITS))
        row = cells.filter(F.col("_upto") >= target - below).orderBy("_cell").first()
        prefix, below = row["_cell"], below + row["_upto"] - row["_n"]
        if row["_n"] == 1:
            return inside.filter(F.startswith("_digest", F.lit(prefix))).first()["_digest"]
    return prefix


def head_by_hash(df: DataFrame, key, n: int, seed: int | str = 42) -> DataFrame:
    """The ``min(n, rows)`` rows with the smallest seeded hash: a reproducible subset.

    A filter, not a sort: no task collects ``n`` candidates from each partition. The hash is
    not the one that splits with the same seed use, so a subset of a side is no edge of it.
    """
    return df.filter(hash_cutoff(df, key, n, f"{seed}:subset").contains())


def copy_tasks(df: DataFrame) -> int:
    """Number of tasks for work on the numbered rows of ``df``, by its row count."""
    return max(1, math.ceil(df.count() / _COPY_ROWS))


def number_copies(df: DataFrame, key, name: str = "copy") -> DataFrame:
    """Number the rows that share ``key`` from 1, so that (key, ``name``) identifies a row.

    Stands in for a row position where the table has no unique key. Identical rows are
    counted before the shuffle and cut into chunks; chunks are spread over salts of their
    content, numbered per (key, salt) and only then expanded, so neither a key nor a run
    of copies that fills a third of the table ends up in one task. A counted table is small
    however many rows it stands for, so its chunks are dealt to a number of tasks that follows
    the rows (``df`` is counted for that). All columns must be orderable.
    """
    columns = df.columns
    names = [key] if isinstance(key, str) else list(key)
    packed = df.groupBy(*columns).agg(F.count("*").alias("_copies"))
    chunks = F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / _COPY_CHUNK))
    chunked = (
        packed.withColumn("_chunk", F.explode(chunks))
        .withColumn("_m", F.least(F.lit(_COPY_CHUNK), F.col("_copies") - F.col("_chunk") * _COPY_CHUNK))
        .withColumn("_salt", F.pmod(F.xxhash64(*columns, "_chunk"), F.lit(_COPY_SALTS)))
    )
    cells = chunked.groupBy(*names, "_salt").agg(F.sum("_m").alias("_n"))
    by_key = Window.partitionBy(*names).orderBy("_salt")
    # At most _COPY_SALTS rows per key.
    offsets = cells.select(
        *[F.col(n).alias(f"_k_{n}") for n in names],
        F.col("_salt").alias("_k_salt"),
        (F.sum("_n").over(by_key) - F.col("_n")).alias("_before"),
    )
    matches = F.col("_salt") == F.col("_k_salt")
    for n in names:
        matches = matches & F.col(n).eqNullSafe(F.col(f"_k_{n}"))
    in_cell = Window.partitionBy(*names, "_salt").orderBy(*columns, "_chunk").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = chunked.withColumn("_upto", F.sum("_m").over(in_cell)).join(offsets, matches)
    tasks = copy_tasks(df)
    if tasks > 1:
        placed = placed.repartition(tasks)
    return (
        placed.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_m"))))
        .withColumn(name, F.col("_before") + F.col("_upto") - F.col("_m") + F.col("_i"))
        .select(*columns, name)
    )
