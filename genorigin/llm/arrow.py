"""Arrow helpers for tasks that work on texts in bounded pieces."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

#: The setting for the bytes of a batch that Spark hands to Python at once, and its value here. Spark's own 64 MB hold a whole partition of texts, in the JVM and once more in Python.
BATCH_BYTES, SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def release() -> None:
    """Give memory that is free within this process back to the system: worker processes live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over small batches: the session's limit of bytes is lowered, unless one has been set. Batches say nothing of the result, as run takes rows as they come."""
    if df.sparkSession.conf.get(BATCH_BYTES, None) is None:
        df.sparkSession.conf.set(BATCH_BYTES, SMALL)
    return df.mapInArrow(run, schema)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most so many bytes of text each, or one row."""
    for batch in batches:
        sizes = np.fromiter((0 if x is None else x for x in pa.compute.binary_length(batch.column(column)).to_pylist()), np.int64, batch.num_rows)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, null as empty, and the n + 1 offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.type != pa.large_string() or column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    everything = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return everything[offsets[0] : offsets[-1]] if len(offsets) else everything[:0], offsets - offsets[0]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of each run, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)
