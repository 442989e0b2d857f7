"""Helpers shared by the operators: table reading, bounded Arrow slices, corpus-wide names."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one step of a Python task works on at a time; a longer row is a step of its own.
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters keep their case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``limit`` bytes, so that results of a step stay small."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


_MEMORY: dict[Hashable, object] = {}


def worker_memory(key: Hashable, make: Callable[[], object]) -> object:
    """What this Python worker remembers from task to task under ``key``. A worker serves the steps of a
    pipeline one after another and holds one memory at a time: that of another step ends here."""
    if key not in _MEMORY:
        forget()
        _MEMORY[key] = make()
    return _MEMORY[key]


def forget() -> None:
    """Ends the memory of this worker, whichever step made it, and gives its pages back."""
    if _MEMORY:
        _MEMORY.clear()
        pa.default_memory_pool().release_unused()


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of bytes other than the six ASCII blanks."""
    return text.lower().split()


def crc_bucket(name: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % n
