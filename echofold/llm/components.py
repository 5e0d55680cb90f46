"""Consolidating pairwise matches into groups: connected components on a two-dimensional grid.

Vertices are hashed into blocks, so that an edge belongs to the cell (block of a, block of b). Every task runs a local
union-find over the cells it holds, which leaves one edge a vertex: to the least vertex it reaches there. A vertex then
hears the representatives of all cells of its row and column; the least becomes its parent, and edges from the others
to it are the contracted graph of the next round. A hub's edges are spread over a whole row of cells, and what it
receives is bounded by the number of cells, not by its degree. Rounds end when every vertex hears one representative.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges and the least vertex each is connected with: union-find by hooking and path halving."""
    names, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = code[: len(a)], code[len(a) :]
    parent = np.arange(len(names))
    while True:
        pu, pv = parent[u], parent[v]
        open_ = pu != pv
        if not open_.any():
            return names, names[parent]
        u, v, pu, pv = u[open_], v[open_], pu[open_], pv[open_]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(np.asarray(x.column("a")), np.asarray(x.column("b"))) for x in batches if x.num_rows]
    if held:
        v, root = local_components(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        for i in range(0, len(v), 1 << 16):
            yield pa.record_batch({"v": pa.array(v[i : i + (1 << 16)]), "root": pa.array(root[i : i + (1 << 16)])})


def grid(edges: int, cores: int, cell_edges: int, least_edges: int) -> tuple[int, int]:
    """Blocks on a side, and tasks. A hub can hold a third of the edges, all in one row of cells: the row must be wide enough, too."""
    cells = min(cores, edges / least_edges)
    side = max(1, math.ceil(math.sqrt(cells)), math.ceil(math.sqrt(edges / cell_edges)), math.ceil(edges / (3 * cell_edges)))
    return side, max(1, min(side * side, max(math.ceil(cells), math.ceil(2 * edges / cell_edges))))


def connected_groups(edges: DataFrame, *, a: str = "a", b: str = "b", cell_edges: int = 1_000_000, least_edges: int = 10_000) -> DataFrame:
    """``v, label``: each vertex of an edge and the least vertex linked to it directly or indirectly.

    Edges with a null end link nothing; directions, repeats and self-edges don't matter (a vertex that has but a
    self-edge isn't listed). The grid has a cell for every core as long as cells hold ``least_edges``, and more so that one holds no more than
    ``cell_edges``, however many edges there are. An empty table gives an empty one.
    """
    spark = edges.sparkSession
    e = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).distinct()
    )
    levels: list[DataFrame] = []
    while True:
        e = materialize(e, "grid-edges")
        n = e.count()
        if not n:
            break
        side, tasks = grid(n, spark.sparkContext.defaultParallelism, cell_edges, least_edges)
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
        reps = (
            e.select("a", "b", block("a").alias("i"), block("b").alias("j"))
            .repartition(tasks, "i", "j").select("a", "b")
            .mapInArrow(_cells, "v long, root long")
            .groupBy("v").agg(F.min("root").alias("label"), F.collect_set("root").alias("roots"))
        )
        reps = materialize(reps, "grid-parents")
        levels.append(reps.select("v", "label"))
        e = reps.where(F.size("roots") > 1).select("label", F.explode("roots").alias("r")).where("r <> label").select(F.col("label").alias("a"), F.col("r").alias("b")).distinct()
    if not levels:
        return spark.createDataFrame([], "v long, label long")
    labels = levels.pop()
    while levels:
        later = labels.select(F.col("v").alias("label"), F.col("label").alias("to"))
        labels = levels.pop().join(later, "label", "left").select("v", F.coalesce("to", "label").alias("label"))
    return labels


def grouped(vertices: DataFrame, edges: DataFrame, *, vertex: str, a: str = "a", b: str = "b") -> DataFrame:
    """``func, group_id`` for every non-null vertex of ``vertices`` and every end of an edge with both ends, once."""
    whole = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    everyone = (
        vertices.select(F.col(vertex).cast("long").alias("v")).where("v is not null")
        .unionByName(whole.select(F.explode(F.array(F.col(a).cast("long"), F.col(b).cast("long"))).alias("v"))).distinct()
    )
    labels = connected_groups(whole.select(a, b), a=a, b=b)
    return everyone.join(labels, "v", "left").select(F.col("v").alias("func"), F.coalesce("label", "v").alias("group_id"))
