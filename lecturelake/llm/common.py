"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, new_path, stored

__all__ = ["CHUNK_BYTES", "blocks", "crc_mod", "discard", "mix", "new_path", "read", "schema_of", "short_batches", "stored", "text_chunks", "utf8"]

#: Bytes of text that the numpy passes take at once; one longer document is still taken whole.
CHUNK_BYTES = 1 << 20


#: Rows and bytes that go to a Python worker at once, whichever is reached first. Spark's default is 10,000 rows of any size.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def short_batches(spark: SparkSession) -> None:
    """Set Arrow batches to ARROW_ROWS and ARROW_BYTES (and one row), unless the session has sizes of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(ARROW_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(ARROW_BYTES))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, for queries over texts."""
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, at_least: int = 1) -> int:
    """The number of partitions that work is dealt out to."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about `limit` bytes; rows are never cut."""
    raw, at = utf8(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def schema_of(df: DataFrame, *names: str) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType, True) for n in names]


def crc_mod(doc_id, n: int):
    """crc32 of an id as text, modulo n (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
