"""Frequency of every distinct value, in occurrences and in records, by recursive radix spilling.

Rows are combined per input task first, then travel to the partition that the leading bits of the value's hash name.
There a task keeps combined counts in memory up to a limit; beyond it, rows are spilled to files of the shared folder by the next bits, and
each file is counted on its own, split again where it is still too large. DuckDB aggregates every piece, itself
out-of-core under a memory limit. Any number of distinct values fits, since a piece is bounded; a value with very many
rows is one row after combining.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import scratch_path
from .hashing import U64, mix

RADIX_BITS = 4


def _combine(values: np.ndarray, counts: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    distinct, at = np.unique(values, return_inverse=True)
    total = lambda x: np.bincount(at, weights=x, minlength=len(distinct)).astype(np.int64)
    return distinct, total(counts), total(records)


def _counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a batch of lists, how often each comes, and in how many of the lists; null values are left out."""
    row = np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0)))
    flat = column.flatten()
    if flat.null_count:
        row, flat = row[np.asarray(flat.is_valid())], flat.drop_null()
    values = np.asarray(flat)
    order = np.lexsort((row, values))
    values, row = values[order], row[order]
    first = np.concatenate(([True], values[1:] != values[:-1]))[: len(values)]
    fresh = first | np.concatenate(([True], row[1:] != row[:-1]))[: len(values)]
    start = np.flatnonzero(first)
    add = lambda x: np.add.reduceat(x, start) if len(start) else np.zeros(0, np.int64)
    return values[start], add(np.ones(len(values), np.int64)), add(fresh.astype(np.int64))


def _rows(columns: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in columns], names=["value", "n", "records"])


def _combiner(limit: int):
    """mapInArrow function (values array<long>) -> (value, n, records): counts of a task's rows, flushed when ``limit`` values are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            found = _counted(batch.column(0))
            if len(found[0]):
                held.append(found)
                size += len(found[0])
            if size > limit:
                yield from _rows(_combine(*map(np.concatenate, zip(*held, strict=True))))
                held, size = [], 0
        if held:
            yield from _rows(_combine(*map(np.concatenate, zip(*held, strict=True))))

    return run


class Spill:
    """Files of one task below a folder on whatever file system it lies."""

    def __init__(self, uri: str):
        self.fs, path = pa.fs.FileSystem.from_uri(uri)
        self.path = f"{path}/{uuid.uuid4().hex}"
        self.made = False

    def write(self, table: pa.Table) -> str:
        if not self.made:
            self.fs.create_dir(self.path, recursive=True)
            self.made = True
        name = f"{self.path}/{uuid.uuid4().hex}.arrow"
        with self.fs.open_output_stream(name) as out, pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
            w.write_table(table)
        return name

    def take(self, name: str) -> pa.Table:
        with self.fs.open_input_stream(name) as f, pa.ipc.open_stream(f) as r:
            table = r.read_all()
        self.fs.delete_file(name)
        return table

    def close(self) -> None:
        if self.made:
            self.fs.delete_dir(self.path)


def radix_counts(pieces: Iterator[pa.Table], spill: Spill, aggregate, *, limit: int, depth: int = 0) -> Iterator[pa.Table]:
    """Sums of ``n`` and ``records`` by ``value``; holds about ``limit`` rows at once, spilling by further hash bits beyond."""
    held: list[pa.Table] = []
    size, files = 0, {}
    bits, shift = U64(2**RADIX_BITS - 1), U64(16 + (RADIX_BITS * depth) % 44)

    def flush():
        whole = pa.concat_tables(held)
        part = ((mix(np.asarray(whole["value"].combine_chunks()).view(U64)) >> shift) & bits).astype(np.int64)
        order = np.argsort(part, kind="stable")
        sorted_, at = whole.take(pa.array(order)), np.searchsorted(part[order], np.arange(2**RADIX_BITS + 1))
        for p in range(2**RADIX_BITS):
            if at[p + 1] > at[p]:
                files.setdefault(p, []).append(spill.write(sorted_.slice(at[p], at[p + 1] - at[p]).combine_chunks()))

    for piece in pieces:
        held.append(piece)
        size += piece.num_rows
        if size > limit:
            flush()
            held, size = [], 0
    if not files:
        if held:
            yield aggregate(held)
        return
    if held:
        flush()
        held = []
    for names in files.values():
        if depth < 12:
            yield from radix_counts(map(spill.take, names), spill, aggregate, limit=limit, depth=depth + 1)
        else:  # all bits are used: what is left are rows of very few values
            yield aggregate([spill.take(x) for x in names])


def duck(memory: str):
    """A connection, and a function that adds up tables with it; pieces are bounded, so that nothing goes to a disk of the machine's own."""
    import duckdb

    db = duckdb.connect(config={"memory_limit": memory, "threads": "1", "temp_directory": ""})

    def aggregate(pieces: list[pa.Table]) -> pa.Table:
        db.register("piece", pa.concat_tables(pieces))
        try:
            return db.sql("SELECT value, sum(n)::BIGINT AS n, sum(records)::BIGINT AS records FROM piece GROUP BY value").to_arrow_table()
        finally:
            db.unregister("piece")

    return db, aggregate


def _counter(folder: str, limit: int, memory: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spill = Spill(folder)
        db, aggregate = duck(memory)
        try:
            for table in radix_counts((pa.Table.from_batches([b]) for b in batches if b.num_rows), spill, aggregate, limit=limit):
                yield from table.select(["value", "n", "records"]).cast(pa.schema([("value", pa.int64()), ("n", pa.int64()), ("records", pa.int64())])).to_batches(max_chunksize=1 << 16)
        finally:
            db.close()
            spill.close()

    return run


def value_counts(records: DataFrame, *, values: str, partitions: int | None = None, limit: int = 100_000, memory: str = "256MB") -> DataFrame:
    """``value, n, records``: how often each value occurs, and in how many records.

    ``values`` is an array<bigint> column, in which values may come again; null values, null and empty arrays count nothing. A task holds
    about ``limit`` rows; what is beyond goes through files of the shared folder, which are gone when the task ends.
    """
    spark = records.sparkSession
    fields = "value long, n long, records long"
    partial = records.select(F.col(values).alias("values")).where(F.size("values") > 0).mapInArrow(_combiner(4 * limit), fields)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch_path(spark, "radix")
    return partial.repartition(parts, F.xxhash64("value")).mapInArrow(_counter(folder if "://" in folder or folder.startswith("file:") else "file://" + folder, limit, memory), fields)


def with_verdict(counts: DataFrame, records: DataFrame, *, values: str, floor: int = 10, share: int = 200) -> DataFrame:
    """Adds ``verdict``: ``rare`` for a value in one record only, ``common`` in more than max(floor, records div share), else null; records count
    if they have at least one value."""
    n = records.where(F.size(F.filter(values, lambda x: x.isNotNull())) > 0).count()
    return counts.withColumn("verdict", F.when(F.col("records") == 1, "rare").when(F.col("records") > max(floor, n // share), "common"))


def term_verdicts(records: DataFrame, *, values: str, floor: int = 10, share: int = 200) -> DataFrame:
    """``value, n, records, verdict`` of the values that are too rare or too common to be useful (``with_verdict``)."""
    return with_verdict(value_counts(records, values=values), records, values=values, floor=floor, share=share).where("verdict is not null")
