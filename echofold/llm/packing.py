"""Filling containers of fixed capacity: conflict-constrained best-fit.

Items and pieces are dealt to groups by hash, each small enough for one task, and every group is packed on its own, largest items
first. Its open containers are ordered by what room they have left; each carries a bitmap of the sources and one of the
duplicate clusters in it. An item takes the tightest container that has room and no conflict: from the container it
would fill best, the search goes on to the next larger room until one is compatible, and only else opens a new one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

PLACED = "id long, anonymous boolean, piece int, size int, container long, place int, start int"


def best_fit(items: Iterable[tuple[int, int, int]], capacity: int, apart: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """(container, start) for each ``(size, source bit, cluster)`` in the given order.

    ``cluster`` below 0 conflicts with nothing, otherwise two items of one cluster never share a container. ``apart`` gives,
    for a source bit, the bits of the sources it can't share with. Sizes must be in 1..capacity.
    """
    apart = apart or {}
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some container has room r
    sources: list[int] = []
    clusters: list[int] = []  # a bitmap over the clusters that come more than once here
    out = []
    for size, source, cluster in items:
        shut, mark = apart.get(source, 0), (1 << cluster) if cluster >= 0 else 0
        ahead, room, found = open_ >> size, size, -1
        while ahead and found < 0:
            step = (ahead & -ahead).bit_length() - 1
            room += step
            ahead >>= step + 1
            at = rooms[room]
            for i in range(len(at) - 1, -1, -1):
                if not (sources[at[i]] & shut or clusters[at[i]] & mark):
                    found = at.pop(i)
                    break
            if found < 0:
                room += 1
            elif not at:
                open_ &= ~(1 << room)
        if found < 0:
            found, room = len(sources), capacity
            sources.append(0)
            clusters.append(0)
        out.append((found, capacity - room))
        sources[found] |= source
        clusters[found] |= mark
        rooms[room - size].append(found)
        if room > size:
            open_ |= 1 << (room - size)
    return out


def packed(items: DataFrame, *, id: str, size: str, source: str, cluster: str, capacity: int = 4096, apart: list[set[str]] | None = None, group_items: int = 16_384) -> DataFrame:
    """``id, piece, size, container, place, start`` of every item.

    An item larger than ``capacity`` is split: full containers of its own, and a last piece that is packed like others. An
    item of size 0 or null needs no room: it comes out once, with a null container, place and start. Items with equal
    non-null ``cluster`` never share a container, nor do items whose sources are in one set of ``apart``. ``place`` counts a
    container's items in order of ``start``. Ties fall to the smaller id, so the result doesn't depend on partitioning.
    Items without an id are packed like others, and come out without.
    """
    rows = materialize(items.select(F.coalesce(F.col(id).cast("long"), F.lit(0)).alias("id"), F.col(id).isNull().alias("anonymous"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), F.col(source).cast("string").alias("source"), F.xxhash64(cluster).alias("cluster"), F.col(cluster).isNotNull().alias("clustered")), "pack-items")
    pieces_of = F.greatest(F.lit(0), F.ceil(F.col("size") / capacity))
    groups = max(1, math.ceil((rows.agg(F.sum(pieces_of).alias("n")).first().n or 0) / group_items))  # of pieces: one text may have any number
    pieces = rows.where("size > 0").select(
        "id", "anonymous", "source", "cluster", "clustered", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / capacity) - 1).cast("int"))).alias("piece"), F.col("size").alias("whole"),
    ).select("id", "anonymous", "piece", F.least(F.lit(capacity), F.col("whole") - F.col("piece") * capacity).cast("int").alias("size"), "source", "cluster", "clustered",
             F.pmod(F.xxhash64("id", "piece", F.lit(17)), F.lit(groups)).cast("int").alias("grp"))
    forbidden = [sorted(s) for s in apart or []]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "anonymous", "id", "piece"], ascending=[False, True, True, True], kind="stable")
        names = {s: 1 << i for i, s in enumerate(sorted(set(pdf["source"].dropna())))}
        shut = {names[s]: sum(names[t] for t in set_ if t != s and t in names) for set_ in forbidden for s in set_ if s in names}
        often = pdf.loc[pdf["clustered"], "cluster"].value_counts()
        bits = {c: i for i, c in enumerate(sorted(often.index[often > 1]))}
        where = best_fit(((s, names.get(src, 0), bits.get(c, -1) if k else -1) for s, src, c, k in zip(pdf["size"], pdf["source"], pdf["cluster"], pdf["clustered"], strict=True)), capacity, shut)
        out = pdf[["id", "anonymous", "piece", "size"]].copy()
        out["container"] = [c for c, _ in where]
        out["start"] = [s for _, s in where]
        out["place"] = out.sort_values("start", kind="stable").groupby("container").cumcount()
        out["container"] += int(pdf["grp"].iloc[0]) << 32
        return out[["id", "anonymous", "piece", "size", "container", "place", "start"]]

    none = F.lit(None)
    empty = rows.where("size <= 0").select("id", "anonymous", F.lit(0).alias("piece"), F.lit(0).alias("size"), none.cast("long").alias("container"), none.cast("int").alias("place"), none.cast("int").alias("start"))
    out = pieces.groupBy("grp").applyInPandas(pack, PLACED).unionByName(empty)
    return out.select(F.when(~F.col("anonymous"), F.col("id")).alias("id"), "piece", "size", "container", "place", "start")
