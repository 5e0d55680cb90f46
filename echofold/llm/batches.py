"""Deduplicating new batches against all history by content-defined chunking.

A record is its values in ascending order, eight bytes each. The rolling hash looks at a window of eight bytes and is read at the ends of
values, so it is the hash of the value that ends there; where its low bit is zero, a chunk ends. (A wider window would make an edit move
the boundaries behind it, and a small record lose all its chunks by few edits.) The chunk table lists, for every accepted record, its
chunks with their bytes, and lives in the shared folder, in buckets of chunk hashes: a delivery of batches reads the buckets its chunks
fall into, once however many batches it has, and appends the chunks of what it accepts. The history is never rewritten.

Exactness. With d values of a record missing in another and e values new there, at most 2d + e of the record's chunks
are lost: a value that ends a chunk takes two with it. Similarity >= theta needs d + theta * e <= (1 - theta) * size, so
at most ``floor(2 * (1 - theta) * size)`` chunks are lost. A new record looks up all its chunks that aren't frequent, the rarest first, at least
one more than can be lost; of the bytes it looks up, all but those of the largest chunks that can be lost must be shared. That share of
bytes decides which records are compared. A record with too few chunks looks up single values instead: the first
``floor((1 - theta) * size) + 1`` in the order of the history (a second level of the table has as many of every record), of which
similar records have one in common. Coverage itself, shared bytes to all bytes of both, is computed on the full sets of what was found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop_path, materialize, scratch_path, small
from .hashing import SKETCH_BITS, U64, frequencies, list_column, mix, sketch_cells

#: Rows up to which what a delivery looks up and finds is broadcast (some 40 bytes each).
SMALL = 500_000
#: Chunk rows of a bucket, when the history begins.
BUCKET_ROWS = 4_000_000
#: A chunk is frequent if its counter holds more than one in so many entries (and more than four).
FREQUENT = 20_000
CHUNKS = "chunk long, id long, size int, bytes int"
RECORDS = "id long, values array<long>"
PROBES = "chunk long, q long, qs int, bytes int, need int, until int"


def lost_chunks(size: np.ndarray, theta: float) -> np.ndarray:
    return np.floor(2 * (1 - theta) * size + 1e-9).astype(np.int64)


def lost_values(size: np.ndarray, theta: float) -> np.ndarray:
    return np.floor((1 - theta) * size + 1e-9).astype(np.int64)


def cut(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk hash, record and length in values of every chunk of records given as ascending lists."""
    n = len(values)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    h = mix(values.view(U64))
    ends = (h & U64(1)) == 0
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    stop = np.flatnonzero(ends)
    start = np.concatenate(([0], stop[:-1] + 1))
    # equal sets of values give equal hashes, and chunks are in ascending order
    with np.errstate(over="ignore"):
        rolled = np.add.reduceat(mix(h + U64(0x9E37)), start) * U64(3) + (stop - start + 1).astype(U64)
    return mix(rolled), row[start], stop - start + 1


def _leading(order: np.ndarray, row: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Of entries ordered by row and rank, the first ``take[row]`` of each row."""
    row = row[order]
    first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(take)))))[:-1]
    return order[np.arange(len(row)) - first[row] < take[row]]


def _single(values: np.ndarray, row: np.ndarray, take: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows of each record's first values in the history's order: by the counters it began with, then by hash."""
    key = mix(mix(values.view(U64)) ^ U64(0xA5A5))
    kept = _leading(np.lexsort((key, rank[sketch_cells(values)] if len(values) else key, row)), row, take)
    return key[kept], row[kept]


def _table(order, theta: float):
    """(id, values) -> rows of the chunk table, both levels: chunks, and the first single values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            values, offsets = list_column(batch.column("values"))
            sizes = np.diff(offsets)
            chunk, row, length = cut(values, offsets)
            single, single_row = _single(values, np.repeat(np.arange(len(ids)), sizes), lost_values(sizes, theta) + 1, order.value)
            keys, rows = np.concatenate((chunk, single)), np.concatenate((row, single_row))
            if len(rows):
                yield pa.record_batch({
                    "chunk": pa.array(keys.view(np.int64)), "id": pa.array(ids[rows]), "size": pa.array(sizes[rows].astype(np.int32)),
                    "bytes": pa.array(np.concatenate((8 * length, np.full(len(single), 8))).astype(np.int32))})

    return run


def _probe(order, counts, theta: float, top: int):
    """(id, until, values) -> what a new record looks up, with the bytes that must be found of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, until = np.asarray(batch.column("id")), np.asarray(batch.column("until"))
            values, offsets = list_column(batch.column("values"))
            sizes = np.diff(offsets)
            chunk, row, length = cut(values, offsets)
            lost = lost_chunks(sizes, theta)
            chunks = np.bincount(row, minlength=len(ids))
            coarse = chunks > lost
            seen = counts.value[sketch_cells(chunk.view(np.int64))] if len(chunk) else np.zeros(0, np.int64)
            common = np.bincount(row, weights=seen > top, minlength=len(ids)).astype(np.int64)
            take = np.where(coarse, np.maximum(lost + 1, chunks - common), 0)
            kept = _leading(np.lexsort((chunk, -length, seen, row)), row, take)
            k1, r1, l1 = chunk[kept], row[kept], length[kept]
            # what can't be lost: all looked up but the ``lost`` largest
            by_size = np.lexsort((-l1, r1))
            gone = _leading(by_size, r1, lost)
            need = 8 * (np.bincount(r1, weights=l1, minlength=len(ids)) - np.bincount(r1[gone], weights=l1[gone], minlength=len(ids)))
            k2, r2 = _single(values, np.repeat(np.arange(len(ids)), sizes), np.where(coarse, 0, lost_values(sizes, theta) + 1), order.value)
            rows = np.concatenate((r1, r2))
            if len(rows):
                yield pa.record_batch({
                    "chunk": pa.array(np.concatenate((k1, k2)).view(np.int64)), "q": pa.array(ids[rows]), "qs": pa.array(sizes[rows].astype(np.int32)),
                    "bytes": pa.array((8 * np.concatenate((l1, np.ones(len(r2), np.int64)))).astype(np.int32)),
                    "need": pa.array(np.where(coarse[rows], need[rows], 8).astype(np.int32)), "until": pa.array(until[rows])})

    return run


def _hashed(records: DataFrame) -> DataFrame:
    return records.where(F.size("values") > 0).select("*", F.xxhash64("values").alias("k1"), F.xxhash64("values", F.lit(7)).alias("k2"))


class History:
    """Accepted records and their chunk table, in the shared folder; a path where one lies already is opened.

    ``accept`` appends, ``judge`` decides on one batch, ``decide`` on a delivery of several. Records are ``(id bigint, values
    array<bigint>)`` with distinct ascending values; null or empty sets are never rejected nor originals. Equal sets are held once,
    under the least id. ``theta`` must be the same whenever a history is opened (it is kept with it).
    """

    def __init__(self, spark: SparkSession, path: str | None = None, theta: float = 0.85):
        self.spark, self.theta = spark, theta
        self.path = path or scratch_path(spark, "history")
        self.buckets, self._order, self._counts, self._top, self._counted, self._rows = 0, None, None, 4, 0, 0
        if path and self._exists("meta"):
            meta = self._read("meta", "theta double, buckets int, cell int, n long").toArrow()
            if meta["theta"][0].as_py() != theta:
                raise ValueError(f"this history was begun with theta {meta['theta'][0]}")
            cells = np.zeros(1 << SKETCH_BITS, np.int64)
            cells[np.asarray(meta["cell"])] = np.asarray(meta["n"])
            self.buckets, self._order = meta["buckets"][0].as_py(), spark.sparkContext.broadcast(cells)
            self.refresh()

    def _exists(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _chunks(self) -> DataFrame:
        return self._read("chunks", f"{CHUNKS}, part int, bucket int")

    def _bucket(self) -> F.Column:
        return F.pmod(F.col("chunk"), F.lit(self.buckets)).cast("int")

    def _begin(self, records: DataFrame) -> None:
        """The order of values that every part's second level follows, and the number of buckets: fixed by the first part."""
        cells = frequencies(records, "values")
        self.buckets = int(min(4096, max(1, cells.sum() // BUCKET_ROWS)))
        kept = np.flatnonzero(cells) if cells.any() else np.zeros(1, np.int64)
        meta = pa.table({"theta": pa.array(np.full(len(kept), self.theta)), "buckets": pa.array(np.full(len(kept), self.buckets, np.int32)), "cell": pa.array(kept.astype(np.int32)), "n": pa.array(cells[kept])})
        self.spark.createDataFrame(meta).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")
        self._order = self.spark.sparkContext.broadcast(cells)

    def accept(self, records: DataFrame, part: int) -> None:
        """Add part number ``part`` to the history, and its chunks to the table. A part added again replaces itself."""
        keyed = _hashed(records.select("id", "values"))
        reps = keyed.groupBy("k1", "k2").agg(F.min("id").alias("id"))
        self._append(keyed.join(reps, ["k1", "k2", "id"], "left_semi").select("id", "values").dropDuplicates(["id"]), part)

    def _append(self, distinct: DataFrame, part: int) -> None:
        own = f"{self.path}/records/part={part}"
        distinct.write.mode("overwrite").parquet(own)
        added = self.spark.read.schema(RECORDS).parquet(own)
        if not self.buckets:
            self._begin(added)
        rows = added.mapInArrow(_table(self._order, self.theta), CHUNKS).withColumn("bucket", self._bucket())
        rows = rows.repartition("bucket", F.pmod(F.col("id"), F.lit(8))) if self.buckets > 1 else rows
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/chunks/part={part}")
        if self._counts is not None:
            self._rows += self.spark.read.schema(CHUNKS).parquet(f"{self.path}/chunks/part={part}").count()
        if self._counts is None or self._rows > 1.5 * self._counted:
            self.refresh()

    def refresh(self) -> None:
        """Count chunks anew (each time the table has grown by half), to know the frequent ones, which are looked up last. Which chunks are looked up depends on it, the
        result doesn't."""
        counts = frequencies(self._chunks(), "chunk")
        self._rows = self._counted = int(counts.sum())
        self._top = max(4, self._rows // FREQUENT)
        self._counts = self.spark.sparkContext.broadcast(counts)

    def judge(self, batch: DataFrame) -> DataFrame:
        """``id, original_id, similarity`` of the batch's records that are rejected: their similarity to an accepted
        record is at least theta; the most similar is the original (ties: the least id)."""
        return self.decide(batch.select("id", F.lit(0).alias("batch"), "values"))[0].select("id", "original_id", "similarity")

    def decide(self, delivery: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Batches in order of their number, each against the history and what was accepted of the batches before it:
        ``(id, batch, original_id, similarity)`` of the rejected records, and ``(id, values)`` of the accepted sets.

        ``delivery(id, batch int, values)`` is looked up as a whole: all its similar records, in the history and among its own earlier
        batches, come from one pass over the table; then the verdicts follow from those links alone (``_settled``).
        """
        keyed = _hashed(delivery.select("id", "batch", "values"))
        held = materialize(keyed.groupBy("k1", "k2", "batch").agg(F.min("id").alias("least")), "delivered-sets")
        sets = held.groupBy("k1", "k2").agg(F.min("batch").alias("since"), F.max("batch").alias("until"), F.min_by("least", "batch").alias("id"))
        sets = materialize(keyed.select("k1", "k2", "id", "values").dropDuplicates(["id", "k1", "k2"]).join(sets, ["k1", "k2", "id"]).select("id", "k1", "k2", "since", "until", "values"), "delivered-classes")
        probes = materialize(sets.select("id", "until", "values").mapInArrow(_probe(self._order, self._counts, self.theta, self._top), PROBES), "probes")
        theta = F.lit(self.theta)
        table = self._chunks().drop("part")
        touched = [r[0] for r in probes.select(self._bucket()).distinct().collect()] if self.buckets > 1 else []  # as many as buckets at most
        if touched and len(touched) < self.buckets:
            table = table.where(F.col("bucket").isin(touched))
        table = table.select("chunk", "id", "size", F.lit(None).cast("int").alias("since"))
        own = sets.select("id", "values").mapInArrow(_table(self._order, self.theta), CHUNKS).join(sets.select("id", "since"), "id").select("chunk", "id", "size", "since")
        # a delivery is small beside the history: as long as it is, the history is read but not shuffled
        found = (
            table.unionByName(own).join(small(probes, SMALL), "chunk")
            .where((F.col("size") >= F.col("qs") * theta - 1e-6) & (F.col("qs") >= F.col("size") * theta - 1e-6) & (F.col("since").isNull() | (F.col("since") < F.col("until")) & (F.col("q") != F.col("id"))))
            .groupBy("q", "id", "since").agg(F.sum("bytes").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("q", "id", "since")
        )
        found = materialize(found, "found")
        theirs = self._read("records", RECORDS).select("id", F.col("values").alias("theirs")).join(small(found.where("since is null"), SMALL), "id")
        ours = sets.select("id", F.col("values").alias("theirs")).join(found.where("since is not null"), "id")
        both = theirs.unionByName(ours).join(sets.select(F.col("id").alias("q"), "values", F.col("since").alias("own_since")), "q")
        covered, whole = 8 * F.size(F.array_intersect("values", "theirs")), 8 * (F.size("values") + F.size("theirs"))
        links = both.select("q", "own_since", "id", "since", (covered / (whole - covered)).alias("similarity")).where(F.col("similarity") >= theta)
        links = materialize(links, "links")
        rejected = self._settled(links)
        accepted = sets.join(rejected, F.col("id") == F.col("q"), "left_anti")
        # of a rejected set the best of what was accepted before each of its batches; of an accepted one itself, for its later batches
        sound = links.join(rejected.select("q"), "q", "left_semi").join(rejected.select(F.col("q").alias("id")), "id", "left_anti").select("q", "id", "since", "similarity")
        sound = sound.unionByName(accepted.where("until > since").select(F.col("id").alias("q"), "id", "since", F.lit(1.0).alias("similarity")))
        asked = held.join(sets.select("k1", "k2", F.col("id").alias("q")), ["k1", "k2"]).select("k1", "k2", "batch", "q")
        best = asked.join(sound, "q").where("since is null or since < batch").groupBy("k1", "k2", "batch").agg(F.max(F.struct("similarity", (-F.col("id")).alias("minus"))).alias("best"))
        out = keyed.select("id", "batch", "k1", "k2").join(best, ["k1", "k2", "batch"]).select("id", "batch", (-F.col("best.minus")).alias("original_id"), F.col("best.similarity").alias("similarity"))
        return out, accepted.select("id", "values")

    @staticmethod
    def _settled(links: DataFrame) -> DataFrame:
        """``q`` of the sets rejected at their first batch. A link into the history rejects at once. Among the delivery's own, a set that
        no earlier one is linked to is accepted and rejects what it is linked to, which settles the next; there are no more rounds
        than batches, and as a rule two or three."""
        gone = links.where("since is null").select("q").distinct()
        open_ = links.where("since < own_since").select("q", "id").join(gone, "q", "left_anti").join(gone.select(F.col("q").alias("id")), "id", "left_anti")
        parts, n = [gone], 0
        while True:
            open_ = materialize(open_, f"open-links-{n}")
            if open_.isEmpty():
                break
            sure = open_.select("id").distinct().join(open_.select(F.col("q").alias("id")), "id", "left_anti")
            now = open_.join(sure, "id", "left_semi").select("q").distinct()
            parts.append(now)
            open_ = open_.join(now, "q", "left_anti").join(now.select(F.col("q").alias("id")), "id", "left_anti")
            n += 1
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return materialize(out, "rejected-sets")

    def close(self) -> None:
        drop_path(self.spark, self.path)


def judge_batches(units: DataFrame, *, first: int = 0, theta: float = 0.85, min_report: int = 0) -> DataFrame:
    """``unit_id, batch_no, original_id, similarity`` of the rejected units of all batches after ``first``.

    ``units(unit_id, batch_no, fps)``, comparable units only. What belongs to ``first`` and before is history, all of it; the batches
    after it are one delivery. Units with a null batch number belong to no batch, rows without id are no units; both are left out.
    """
    spark = units.sparkSession
    records = materialize(units.where("batch_no is not null and unit_id is not null").select(F.col("unit_id").alias("id"), F.col("batch_no").cast("int").alias("batch"), F.col("fps").alias("values")), "batch-records")
    history = History(spark, theta=theta)
    history.accept(records.where(F.col("batch") <= first), first)
    rejected, _ = history.decide(records.where(F.col("batch") > first))
    return rejected.where(F.col("batch") > min_report).select(F.col("id").alias("unit_id"), F.col("batch").alias("batch_no"), "original_id", "similarity")
