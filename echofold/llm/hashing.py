"""Vectorised 64-bit mixing and frequency sketches shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (public-domain xor-multiply-shift construction)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        return x ^ (x >> U64(32))


def list_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (from 0) of a list column; null lists are empty, null values aren't expected."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    return np.asarray(column.flatten()), np.concatenate(([0], np.cumsum(lengths)))


#: Counters of a frequency sketch: two bits to the power of this.
SKETCH_BITS = 18


def sketch_cells(values: np.ndarray) -> np.ndarray:
    return (mix(values.view(U64) ^ U64(0x51A7C0DE)) >> U64(64 - SKETCH_BITS)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        column = batch.column(0)
        flat = np.asarray(column.flatten() if pa.types.is_list(column.type) else column)
        if len(flat):
            held += np.bincount(sketch_cells(flat), minlength=len(held))
    cells = np.flatnonzero(held)
    if len(cells):
        yield pa.record_batch({"cell": pa.array(cells.astype(np.int32)), "n": pa.array(held[cells])})


def frequencies(df: DataFrame, column: str) -> np.ndarray:
    """A sketch of how often every value of ``column`` (bigint or array<bigint>, without nulls) occurs: a fixed number of counters, values that
    share one are taken for equally frequent. Counted over all rows; a task sends its counters, whatever it has read."""
    sums = df.select(column).mapInArrow(_tally, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    rows = sums.toArrow()  # at most one row a counter
    out[np.asarray(rows["cell"])] = np.asarray(rows["n"])
    return out
