"""Series of snapshots: picking them, smoothing their scores, finding when growth began."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def month_last(commits: DataFrame, *, group: str, order: str, month: Column) -> DataFrame:
    """The last commit of every run of equal months, in order; a month that comes again later is another run.

    Keeps the columns of ``commits`` and adds ``month``. Nulls in ``order`` come first.
    """
    w = Window.partitionBy(group).orderBy(order)
    return commits.withColumn("month", month).withColumn("_next", F.lead("month").over(w)).withColumn("_more", F.lead(F.lit(1)).over(w)).where(F.col("_more").isNull() | ~F.col("month").eqNullSafe(F.col("_next"))).drop("_next", "_more")


def evenly_spaced(rows: DataFrame, *, group: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows a group at even distances, the first and the last included; of ``most`` = 1 the last."""
    w = Window.partitionBy(group)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    if most <= 1:
        picked = F.col("_i") == F.col("_n") - 1
    else:
        # row i is the k-th pick, k * (n - 1) div (most - 1), for some k
        k = f"(_i * {most - 1} + greatest(_n - 1, 1) - 1) div greatest(_n - 1, 1)"
        picked = F.expr(f"_n <= {most} or (({k}) < {most} and (({k}) * (_n - 1)) div {most - 1} = _i)")
    return numbered.where(picked).drop("_i", "_n")


def smooth(series: DataFrame, *, group: str, order: str, value: str, out: str = "smoothed") -> DataFrame:
    """Adds the centred mean of three, of two at the ends. Null values don't count."""
    return series.withColumn(out, F.avg(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(-1, 1)))


def inflection(series: DataFrame, *, group: str, order: str, value: str, date: str) -> DataFrame:
    """``group, growth_factor, growth_since``, one row a group; nulls where a series has fewer than three points or didn't grow.

    The least of the smoothed values is compared with the last: a factor of 1.5 and more counts, unless the least is the last.
    Where the least is about zero a factor says nothing: then ``growth_since`` is the date of the last clean point, if the
    end isn't clean. Points without a value are left out.
    """
    w = Window.partitionBy(group)
    s = smooth(series.where(F.col(value).isNotNull()).select(group, order, F.col(value).cast("double").alias("_v"), F.col(date).alias("_d")), group=group, order=order, value="_v", out="_s")
    s = s.withColumn("_i", F.row_number().over(w.orderBy(order)))
    agg = s.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("_s", "_i").alias("now"), F.min(F.struct("_s", "_i", "_d")).alias("low"),
        F.max(F.when(F.col("_v") <= K.CLEAN_SCORE, F.struct("_i", "_d"))).alias("clean"), F.min(F.struct("_i", "_d")).alias("first"))
    clean = F.coalesce("clean", "first")
    zero = F.col("low._s") <= K.CLEAN_SCORE
    from_zero = zero & (F.col("now") >= K.DIRTY_SCORE) & (clean["_i"] < F.col("n"))
    grown = ~zero & (F.col("now") / F.col("low._s") >= K.GROWTH_FACTOR) & (F.col("low._i") < F.col("n"))
    enough = F.col("n") >= 3
    return agg.select(group, F.when(enough & grown, F.col("now") / F.col("low._s")).alias("growth_factor"), F.when(enough & grown, F.col("low._d")).when(enough & from_zero, clean["_d"]).alias("growth_since"))


def fresh_blobs(tree: DataFrame, *, snapshots: DataFrame) -> DataFrame:
    """``oid, commit`` of the snapshot in which each blob is seen first: what has to be analysed when. ``snapshots(commit, at)``."""
    seen = tree.where("oid is not null").select("commit", F.lower("oid").alias("oid")).distinct().join(snapshots, "commit")
    return seen.groupBy("oid").agg(F.min(F.struct("at", "commit")).alias("first")).select("oid", F.col("first.commit").alias("commit"))


def prefix_until(rows: DataFrame, *, order: str, size: str, target: int) -> DataFrame:
    """The shortest prefix in ``order`` whose total ``size`` reaches ``target`` (all rows if none does); null sizes count 0.

    The running total is taken range by range: totals of up to 64 ranges of ``order`` go to the driver, then only the
    ranges in reach are summed row by row.
    """
    value = F.coalesce(F.col(size), F.lit(0))
    ranges = rows.repartitionByRange(64, order).withColumn("_p", F.spark_partition_id())
    from ..scratch import materialize

    ranges = materialize(ranges, "prefix")
    totals = sorted((r["_p"], r["t"]) for r in ranges.groupBy("_p").agg(F.sum(value).alias("t")).collect())
    offsets, sum_ = {}, 0
    for p, t in totals:
        if sum_ < target:
            offsets[p] = sum_
        sum_ += t
    if not offsets:
        return ranges.drop("_p").limit(0)
    base = F.element_at(F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]), F.col("_p"))
    before = F.sum(value).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return ranges.where(F.col("_p").isin(list(offsets))).withColumn("_b", F.coalesce(before, F.lit(0)) + base).where(F.col("_b") < target).drop("_p", "_b")
