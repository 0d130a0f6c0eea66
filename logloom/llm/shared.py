"""Helpers of the operators: learning splits, text bytes, Arrow columns, staged results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import bound_batches, checkpoint_dir, stage

__all__ = ["byte_ranges", "checkpoint_dir", "id_remainder", "slices", "stage", "table", "text_binary"]

# Bytes of text that the numpy kernels hold at once; a longer single text is held alone.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bound_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % modulus).cast("int")


def text_binary(text: Column) -> Column:
    """The UTF-8 bytes of a text column; a null text is empty."""
    return F.coalesce(text.cast("string").cast("binary"), F.lit(b""))


def byte_ranges(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow column without nulls, and the n + 1 offsets of its rows."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of at most ``size`` bytes, or of one longer row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) and the first word of each row.

    ``offsets`` are relative to ``data``; words do not reach over the end of a row.
    """
    inside = ~_SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    first = before[:-1].copy()
    edges = offsets[1:-1]
    first[edges[edges < len(data)]] = False
    starts = np.flatnonzero(inside & ~first)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")
