"""What changed between full snapshots.

Both snapshots of every transition are unioned, tagged by side and grouped by key once: the same shuffle picks the
row that holds on either side (the latest delivery) and compares the sides' row hashes.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from ..scratch import small


def transitions(points: DataFrame, delivered: DataFrame, *, group: str = "repo", snapshot: str = "commit", order: str = "committed_at") -> DataFrame:
    """Consecutive delivered snapshots of a group: ``old, new``.

    ``delivered`` holds the distinct snapshots that have rows at all; others are skipped, so that the next one is
    compared with the last that was delivered. Repeated points count once (the earliest ``order`` holds); ties in
    ``order`` fall to the smaller snapshot id. Points without snapshot, group or order are ignored.
    """
    known = (
        points.select(F.col(group).alias("g"), F.col(snapshot).alias("s"), F.col(order).alias("o"))
        .where("g is not null and s is not null and o is not null")
        .groupBy("g", "s").agg(F.min("o").alias("o"))
        .join(delivered.select(F.col(snapshot).alias("s")).where("s is not null").distinct(), "s", "left_semi")
    )
    w = Window.partitionBy("g").orderBy("o", "s")
    return known.select(F.lag("s").over(w).alias("old"), F.col("s").alias("new")).where("old is not null")


def snapshot_changes(rows: DataFrame, steps: DataFrame, *, snapshot: str, key: Column, value: Column, version: Column, sides: int = 100_000) -> DataFrame:
    """``snapshot, key, change`` for every key added, removed or changed by a step of ``steps`` (``old, new``).

    ``version`` (a timestamp or a whole number) orders several rows of one snapshot and key: the greatest holds (ties: the greatest row hash). Rows
    with a null key or value are ignored. Every row is tagged with the steps in which it is the old and the new side,
    at most two, and one aggregation on (step, key) classifies from the two sides' hashes. Keys are as many as rows,
    so that no group can be large; the steps are few, and are broadcast only while fewer than ``sides`` (checked),
    else joined by shuffle.
    """
    numbered = steps.select("old", "new", F.xxhash64("old", "new").alias("step"))
    tagged = numbered.select(F.explode(F.array(
        F.struct(F.col("old").alias("s"), "step", F.lit(0).alias("side"), "new"),
        F.struct(F.col("new").alias("s"), "step", F.lit(1).alias("side"), "new"))).alias("t")).select("t.*")
    tagged = small(tagged, sides)
    held = F.max(F.when(F.col("side") == 0, F.col("row"))), F.max(F.when(F.col("side") == 1, F.col("row")))
    slim = rows.select(F.col(snapshot).alias("s"), key.alias("key"), version.alias("version"), F.when(value.isNotNull(), F.xxhash64(value)).alias("value")).where("key is not null and value is not null")
    kind = slim.schema["version"].dataType
    stamp = F.unix_micros("version") if isinstance(kind, TimestampType) else F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', version)") if isinstance(kind, TimestampNTZType) else F.col("version").cast("long")
    # version and hash side by side in one decimal of fixed width, so that the aggregation is by hash and not by sorting
    packed = F.coalesce(stamp, F.lit(-(1 << 62))).cast("decimal(20,0)") * F.lit(Decimal(1 << 64)).cast("decimal(20,0)") + F.col("value").cast("decimal(20,0)") + F.lit(Decimal(1 << 63)).cast("decimal(20,0)")
    both = (
        slim.select("s", "key", packed.cast("decimal(38,0)").alias("row")).join(tagged, "s")
        .groupBy("new", "step", "key").agg(held[0].alias("was"), held[1].alias("now"))
    )
    low = lambda c: F.pmod(F.col(c), F.lit(Decimal(1 << 64)).cast("decimal(20,0)"))
    change = (F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed")
              .when((F.col("was") != F.col("now")) & (low("was") != low("now")), "changed"))
    return both.select(F.col("new").alias("snapshot"), "key", change.alias("change")).where("change is not null")
