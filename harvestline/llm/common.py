"""What all operators of this folder share: tables, scratch tables, column checks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harvestline.session import cut_lineage, scratch_path, ship_package

SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"

__all__ = ["SPACES", "WORD", "cut_lineage", "give_back", "pieces", "prepared", "remainder", "scratch_path", "slices",
           "stored", "strings", "table", "texts_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator reads, so that clashing extra columns cannot matter, with
    this package on the Python workers' path."""
    ship_package(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in columns])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it back: later branches see
    the same rows, and a lost executor costs a re-read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id's text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def give_back() -> None:
    """Returns the memory that this Python worker has freed to the system. Spark keeps idle workers and takes
    them in turn, so that all would hold the peak of their last task beside those at work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not the GNU C library
        pass


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return raw, off


def slices(off: np.ndarray, size: int = 1 << 20, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``size`` bytes and at most ``rows`` rows (one row at
    least), so that temporaries stay small whatever a batch holds."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n, i + rows)
        yield i, j
        i = j


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 1 << 20,
           rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut to slices: the rows, the bytes of their texts, and offsets from 0."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, off = strings(batch.column(batch.schema.get_field_index(text)))
        for i, j in slices(off, size, rows):
            yield batch.slice(i, j - i), raw[off[i]:off[j]], off[i:j + 1] - off[i]
        del raw, off
    batch = None
    give_back()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t if t is not None else "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
