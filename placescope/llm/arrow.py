"""Arrow helpers shared by the text operators: whole columns as byte buffers, bounded blocks of rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18


def narrow(docs: DataFrame, id_col: str, text_col: str, text: Column | None = None) -> DataFrame:
    """Id and text only, under fixed names, so that other columns of the input cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(text_col) if text is None else text).cast("string").alias("text"))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its int64 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8), offsets


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [first, end) of at most ``most`` bytes, or of one longer row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end
        first = end


def strings(column: pa.Array) -> Iterator[str]:
    """The texts one by one; null counts as empty."""
    for value in column:
        yield value.as_py() or ""


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Return memory that the allocators hold but do not use to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


class Lean:
    """A batch function that gives freed memory back to the system when its task ends.

    Spark keeps idle Python workers for the next stages; what their allocators hold on to would stand
    beside those stages' own memory.
    """

    def __init__(self, run: Batches) -> None:
        self.run = run

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from self.run(batches)
        finally:
            give_back()
