"""From pairs to ranked clusters: members, representatives, nested ones suppressed, deletable lines, score.

Units are ``unit_id, file_id, file, name, start_line, end_line, start_byte, end_byte, sig_lines, is_test,
is_trait_impl_method, fps``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import grade, jaccard
from ..scratch import materialize, small
from .graph import components

PLACE = ("file_id", "start_byte", "end_byte")


def drop_nested_members(members: DataFrame) -> DataFrame:
    """Members that don't lie strictly inside another member of their cluster (same file, other span).

    One pass over the distinct spans of a file in order of begin: a span is inside an earlier one if one of those ends no earlier.
    """
    spans = members.select("cluster", *PLACE).where("file_id is not null and start_byte is not null and end_byte is not null").distinct()
    before = Window.partitionBy("cluster", "file_id").orderBy("start_byte", F.desc("end_byte")).rowsBetween(Window.unboundedPreceding, -1)
    inner = spans.withColumn("reach", F.max("end_byte").over(before)).where("reach >= end_byte").select("cluster", *PLACE)
    return members.join(inner, ["cluster", *PLACE], "left_anti")


def drop_nested_clusters(members: DataFrame) -> DataFrame:
    """Members of the clusters that don't lie, member by member, strictly inside members of one other cluster.

    Spans meet by file and bin: one of up to 2^k bytes lies in at most two bins of that width, and what begins in it begins in one of those,
    so that only spans which overlap are compared, however many a file has.
    """
    level = F.ceil(F.log2(F.greatest(F.lit(1), F.col("end_byte") - F.col("start_byte")))).cast("int")
    bin_ = lambda at, k: F.floor(F.col(at) / F.pow(F.lit(2.0), k)).cast("long")
    placed = members.where("file_id is not null and start_byte is not null and end_byte is not null")
    inner = placed.select(F.col("cluster").alias("i"), F.col("unit_id").alias("m"), *[F.col(c).alias("i_" + c) for c in PLACE], F.explode(F.sequence(level, F.lit(31))).alias("level"))
    inner = inner.withColumn("bin", bin_("i_start_byte", F.col("level")))
    outer = placed.select(F.col("cluster").alias("j"), *[F.col(c).alias("j_" + c) for c in PLACE], level.alias("level"))
    outer = outer.withColumn("bin", F.explode(F.array_distinct(F.array(bin_("j_start_byte", F.col("level")), bin_("j_end_byte", F.col("level"))))))
    inside = ((F.col("i_file_id") == F.col("j_file_id")) & (F.col("level") == F.col("o_level")) & (F.col("bin") == F.col("o_bin")) & (F.col("i") != F.col("j")) & (F.col("i_start_byte") >= F.col("j_start_byte")) & (F.col("i_end_byte") <= F.col("j_end_byte"))
              & ((F.col("i_start_byte") != F.col("j_start_byte")) | (F.col("i_end_byte") != F.col("j_end_byte"))))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    covered = inner.join(outer.withColumnsRenamed({"level": "o_level", "bin": "o_bin"}), inside).select("i", "j", "m").distinct().groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    gone = covered.join(sizes, F.col("i") == F.col("cluster")).where("n = size").select("cluster").distinct()
    return members.join(gone, "cluster", "left_anti")


def ranked_members(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """``cluster, representative, similarity, member_order`` and the unit's columns of every member that is left.

    A cluster is a connected component of the pairs, named by its least unit. After nested members are dropped, clusters of
    one are, then clusters nested in others. The representative is the first in ``member_order``: most significant lines, then file, line and id.
    ``similarity`` is that to the representative.
    """
    labels = components(pairs).select(F.col("v").alias("unit_id"), F.col("label").alias("cluster"))
    members = drop_nested_members(units.join(labels, "unit_id"))
    alone = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("cluster")
    members = materialize(drop_nested_clusters(members.join(alone, "cluster", "left_anti")), "cluster-members")
    order = F.struct((-F.col("sig_lines")).isNull().alias("o0"), (-F.col("sig_lines")).alias("o1"), F.col("file").alias("o2"), F.col("start_line").alias("o3"), F.col("unit_id").alias("o4"))
    keyed = members.withColumn("_order", order)
    first = keyed.groupBy("cluster").agg(F.min("_order").alias("_first")).select("cluster", F.col("_first.o4").alias("_rep"))
    rep = first.join(members.select(F.col("unit_id").alias("_rep"), F.col("fps").alias("_fps")), "_rep")
    own = F.col("unit_id") == F.col("_rep")
    return (keyed.join(rep, "cluster").withColumn("representative", own).withColumn("similarity", F.when(own, F.lit(1.0)).otherwise(jaccard(F.col("fps"), F.col("_fps"))))
            .withColumnRenamed("_order", "member_order").drop("_rep", "_fps"))


def with_rank(ranked: DataFrame) -> DataFrame:
    """Adds ``rank``, 1 for the representative. Numbers run through ranges of the order, so that a large cluster is spread over many."""
    numbered = global_numbers(ranked.withColumn("_key", F.struct("cluster", "member_order")), "_key", "_n")
    first = numbered.groupBy("cluster").agg(F.min("_n").alias("_least"))
    return numbered.join(first, "cluster").withColumn("rank", F.col("_n") - F.col("_least") + 1).drop("_n", "_least", "_key")


def global_numbers(df: DataFrame, key: str, out: str) -> DataFrame:
    """Adds ``out``: 1, 2, ... in order of ``key``. Rows are split into ranges; what each range adds is a sum of counts of ranges."""
    parts = materialize(df.repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))  # as many rows as ranges
    before = small(sizes.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b")), 100_000)
    return parts.join(before, "_p").withColumn(out, F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy(key))).drop("_p", "_b")


def cluster_rows(ranked: DataFrame) -> DataFrame:
    """One row a cluster: ``cluster, copies, similarity`` (mean of the others to the representative)``, deletable_lines,
    test_only, trait_impl_only, rep_file, rep_line``."""
    other = ~F.col("representative")
    return ranked.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("copies"), F.coalesce(F.avg(F.when(other, F.col("similarity"))), F.lit(1.0)).alias("similarity"),
        F.coalesce(F.sum(F.when(other, F.col("sig_lines"))), F.lit(0)).cast("long").alias("deletable_lines"),
        F.bool_and(F.coalesce("is_test", F.lit(False))).alias("test_only"), F.bool_and(F.coalesce("is_trait_impl_method", F.lit(False))).alias("trait_impl_only"),
        F.max(F.when(F.col("representative"), F.col("file"))).alias("rep_file"), F.max(F.when(F.col("representative"), F.col("start_line"))).alias("rep_line"))


def cluster_order() -> list[Column]:
    """The total order of clusters: deletable lines, then the representative's place, then the name."""
    return [F.desc("deletable_lines"), F.asc_nulls_first("rep_file"), F.asc_nulls_first("rep_line"), F.asc("cluster")]


def top_clusters(clusters: DataFrame, n: int) -> DataFrame:
    return clusters.orderBy(*cluster_order()).limit(n)


def score(clusters: DataFrame, significant_lines: Column, include_tests: bool = False) -> DataFrame:
    """One row ``deletable_lines, percent, grade``. ``significant_lines`` is the total (a literal or a scalar subquery).
    Clusters of trait methods never count, clusters of tests only if asked for; without lines the score is 0."""
    counted = ~F.col("trait_impl_only") & (F.lit(include_tests) | ~F.col("test_only"))
    total = clusters.agg(F.coalesce(F.sum(F.when(counted, F.col("deletable_lines"))), F.lit(0)).cast("long").alias("deletable_lines"))
    out = total.withColumn("percent", F.when(significant_lines > 0, F.col("deletable_lines") * 100.0 / significant_lines).otherwise(F.lit(0.0)))
    return out.withColumn("grade", grade(F.col("percent")))
