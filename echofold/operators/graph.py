"""Connected components by alternating large-star and small-star steps, each an aggregation of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``v, label``: every vertex of an edge with two different ends, and the least vertex of its component.

    Null ends and self-edges link nothing. A vertex's neighbours are never gathered: their least is an aggregate with map-side
    combine that is joined back, so that a hub's edges stay where they are. Rounds end when no edge changes.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("u"), F.col(b).alias("v")).distinct()
    e, was = materialize(e, "edges"), None
    if e.isEmpty():
        return e.select("v", F.col("u").alias("label"))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours hang below the least of the neighbourhood
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "edges")
        # small star: a vertex and what it still hangs below all go below the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialize(small, "edges")
        now = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == was and not new.join(e, ["u", "v"], "left_anti").take(1):
            return e.select(F.col("u").alias("v"), F.col("v").alias("label")).unionByName(e.select("v", F.col("v").alias("label"))).distinct()
        e, was = new, now
