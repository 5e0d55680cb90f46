"""Near-duplicate records: an exact size-aware heavy-light similarity self-join of sets.

Two sets of sizes t <= s with Jaccard similarity >= theta share at least ``ceil(theta * s)`` values, whatever t.
Light sets (up to a boundary size) enumerate all k-subsets of a prefix in one global, rarest-first order (by a frequency sketch of fixed
size over all sets, then by hash): with the
prefix of ``s - ceil(theta * s) + k`` values, two similar sets have a k-subset of their prefixes in common. For heavy
sets the subsets would be too many; they scan inverted lists of single prefix values instead, into which every set
that can be similar to a heavy one is entered. The boundary between them minimises an estimated cost over the
histogram of set sizes. Candidates of both ways are verified on the full sets, so the result is exact.

Equal sets of one group are one class; the join runs on classes, and membership tells which record is in which.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .hashing import U64, frequencies, list_column, mix, sketch_cells

#: Members of a class that are expanded together: pairs within and between classes are made block by block of members.
BLOCK = 256


def need(size: int, theta: float) -> int:
    """Values that a set of this size shares at least with any set similar to it."""
    return max(1, math.ceil(theta * size - 1e-9))


def prefix_length(size: int, theta: float, k: int) -> int:
    return min(size, size - need(size, theta) + k)


def subsets(size: int, theta: float, k: int) -> int:
    """How many k-subsets a light set of this size enumerates."""
    return math.comb(prefix_length(size, theta, k), k)


def light_boundary(histogram: list[tuple[int, int]], mean_list: float, theta: float, k: int) -> int:
    """Largest size that is still light, by cost: a subset costs its row; an inverted list entry costs its row too, and
    scanning a list costs its mean length for each heavy set that reads it. ``histogram``: (size, sets)."""
    sizes = sorted(histogram)
    best, boundary = math.inf, 0
    for b in [0] + [s for s, _ in sizes]:
        light = sum(n * subsets(s, theta, k) for s, n in sizes if k <= s <= b)
        lists = sum(n * prefix_length(s, theta, 1) for s, n in sizes if s > b or s >= theta * b)
        scans = sum(n * prefix_length(s, theta, 1) * mean_list for s, n in sizes if s > b)
        cost = light + (lists + scans if any(s > b for s, _ in sizes) else 0)
        if cost <= best:
            best, boundary = cost, b
    return boundary


def set_classes(records: DataFrame, *, id: str, group: str, values: str) -> tuple[DataFrame, DataFrame]:
    """``(members, classes)``: ``members(id, rep)`` and ``classes(rep, grp, fps, n)``, one class for equal sets of a group.

    Sets are identified by 128 bits of hash; the least id represents its class. Sets are aggregated with map-side
    combine, so that a class that holds a third of all records is no hot spot.
    """
    keyed = records.select(F.col(id).alias("id"), F.col(group).alias("grp"), F.col(values).alias("fps")).select(
        "id", "grp", "fps", F.xxhash64("grp", "fps").alias("k1"), F.xxhash64("fps", F.lit(71), "grp").alias("k2"))
    classes = keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("grp").alias("grp"), F.any_value("fps").alias("fps"))
    classes = materialize(classes, "set-classes")
    members = keyed.select("id", "k1", "k2").join(classes.select("k1", "k2", "rep", "n"), ["k1", "k2"]).select("id", "rep", "n")
    return members, classes.drop("k1", "k2")


def _signer(counts, theta: float, k: int, boundary: int):
    """mapInArrow function: (rep, grp_hash, fps) -> (sig, rep, size, kind); kind 0 a light set's subset, 1 an inverted list's
    entry, 2 a heavy set's entry, 3 that of a set too small to be sure of k shared values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combos: dict[int, np.ndarray] = {}
        low = theta * boundary
        for batch in batches:
            if not batch.num_rows:
                continue
            rep = np.asarray(batch.column("rep"))
            grp = np.asarray(batch.column("grp")).view(U64)
            fps, offsets = list_column(batch.column("fps"))
            sizes = np.diff(offsets)
            row = np.repeat(np.arange(len(rep)), sizes)
            df = counts.value[sketch_cells(fps)] if len(fps) else fps
            hashed = mix(fps.view(U64))
            ordered = hashed[np.lexsort((hashed, df, row))]
            out: list[tuple[np.ndarray, np.ndarray, int]] = []
            for size in np.unique(sizes):
                size = int(size)
                if not size:
                    continue
                rows = np.flatnonzero(sizes == size)
                prefix = prefix_length(size, theta, k)
                if k <= size <= boundary:
                    if prefix not in combos:
                        combos[prefix] = np.array(list(itertools.combinations(range(prefix), k)), dtype=np.int64)
                    step = max(1, 2_000_000 // combos[prefix].size)
                    for i in range(0, len(rows), step):
                        part = rows[i : i + step]
                        picked = ordered[(offsets[part][:, None, None] + combos[prefix][None])]
                        with np.errstate(over="ignore"):
                            sig = np.repeat(grp[part][:, None] + U64(0x5851F42D4C957F2D), len(combos[prefix]), axis=1)
                            for j in range(k):
                                sig = mix(sig * U64(31) + picked[:, :, j])
                        out.append((sig, part, 0))
                tiny = need(size, theta) < k
                if size > boundary or tiny or size >= low:
                    one = prefix_length(size, theta, 1)
                    picked = ordered[offsets[rows][:, None] + np.arange(one)[None]]
                    out.append((mix(picked ^ grp[rows][:, None]), rows, 2 if size > boundary else 3 if tiny else 1))
            for sig, rows, kind in out:
                n = sig.shape[1]
                yield pa.record_batch({
                    "sig": pa.array(sig.ravel().view(np.int64)),
                    "rep": pa.array(np.repeat(rep[rows], n)),
                    "size": pa.array(np.repeat(sizes[rows], n).astype(np.int32)),
                    "kind": pa.array(np.full(len(rows) * n, kind, dtype=np.int32)),
                })

    return run


def similar_classes(classes: DataFrame, *, theta: float, k: int = 2) -> DataFrame:
    """``a, b, similarity`` (a < b) of all pairs of classes of one group with Jaccard similarity >= ``theta``.

    ``classes(rep, grp, fps)``: distinct sets, without nulls or repeats inside; null groups are never similar. Empty
    sets match nothing. An empty table gives an empty result.
    """
    spark = classes.sparkSession
    sets = classes.where(F.col("grp").isNotNull() & (F.size("fps") > 0)).select("rep", F.xxhash64("grp").alias("grp"), "fps")
    hist = [(r.s, r.n) for r in sets.groupBy(F.size("fps").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()]
    counts = frequencies(sets, "fps")
    total = sum(s * n for s, n in hist)
    cold = total / max(1, sets.select(F.explode("fps").alias("fp")).agg(F.approx_count_distinct("fp").alias("n")).first().n)
    boundary = light_boundary(hist, max(1.0, cold), theta, k)
    # signed once, read by both sides of the join
    signed = materialize(sets.mapInArrow(_signer(spark.sparkContext.broadcast(counts), theta, k, boundary), "sig long, rep long, size int, kind int"), "set-signatures")
    a, b = signed.alias("a"), signed.alias("b")
    # the larger set (ties: the larger id) is b; lists are scanned by heavy (2) and tiny (3) sets only
    near = (
        (F.col("a.sig") == F.col("b.sig"))
        & (F.col("a.size") >= F.col("b.size") * F.lit(theta) - F.lit(1e-6))
        & ((F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.rep") < F.col("b.rep"))))
        & (F.col("b.kind") != 1)
    )
    candidates = a.join(b, near).select(F.col("a.rep").alias("x"), F.col("b.rep").alias("y")).distinct()
    side = lambda r, f: sets.select(F.col("rep").alias(r), F.col("grp").alias("g" + r), F.col("fps").alias(f))
    both = candidates.join(side("x", "fx"), "x").join(side("y", "fy"), "y").where("gx = gy")
    shared_n = F.size(F.array_intersect("fx", "fy"))
    return (
        both.select("x", "y", shared_n.alias("i"), (F.size("fx") + F.size("fy")).alias("n"))
        .select("x", "y", (F.col("i") / (F.col("n") - F.col("i"))).alias("similarity"))
        .where(F.col("similarity") >= theta)
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    )


def similar_record_classes(records: DataFrame, *, id: str, group: str, values: str, theta: float = 0.8, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """``(links, members)``: ``links(a, b, similarity)`` (a < b) between classes of equal sets of one non-null group with Jaccard similarity >=
    ``theta``, and ``members(id, rep, n)``, the class of every record that has a set and a group, by its least id, with its size.

    The result to keep where copies are many: they cost a row each. Ids must not be null; records with an empty set match nothing.
    """
    sound = records.where(F.col(id).isNotNull() & F.col(group).isNotNull() & (F.size(values) > 0))
    members, classes = set_classes(sound, id=id, group=group, values=values)
    return similar_classes(classes, theta=theta, k=k), members


def similar_records(records: DataFrame, *, id: str, group: str, values: str, theta: float = 0.8, k: int = 2) -> DataFrame:
    """``a, b, similarity`` (a < b) of all pairs of records of one non-null group with Jaccard similarity >= ``theta``.

    ``records``: one row an id; ``values`` an array without nulls or repeats. The links of ``similar_record_classes`` expanded over
    their members, copies of one set among themselves. Members are numbered in blocks of about ``BLOCK`` (by hash, their number by the class's
    size), and a link goes out once for each pair of blocks: that is what travels by key, so that no key holds more than a block's pairs.
    """
    links, members = similar_record_classes(records, id=id, group=group, values=values, theta=theta, k=k)
    members = materialize(members, "class-members")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = members.select("id", "rep", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    sizes = members.where("id = rep").select("rep", blocks.alias("blocks"), "n")
    own = sizes.where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"), F.col("blocks").alias("na"), F.col("blocks").alias("nb"))
    side = lambda x: sizes.select(F.col("rep").alias(x), F.col("blocks").alias("n" + x))
    all_ = links.join(side("a"), "a").join(side("b"), "b").select("a", "b", "similarity", "na", "nb").unionByName(own)
    grid = all_.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    grid = grid.where("a <> b or i <= j").select("a", "b", "similarity", "i", "j")
    left, right = placed.select(F.col("rep").alias("a"), F.col("block").alias("i"), F.col("id").alias("ia")), placed.select(F.col("rep").alias("b"), F.col("block").alias("j"), F.col("id").alias("ib"))
    return (
        grid.join(left, ["a", "i"]).join(right, ["b", "j"])
        .where((F.col("a") != F.col("b")) | (F.col("i") < F.col("j")) | (F.col("ia") < F.col("ib")))
        .select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "similarity")
    )
