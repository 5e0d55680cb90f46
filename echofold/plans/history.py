"""Duplication over the history of a repository: all snapshots in one job, every blob analysed once."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..extract.units import analysed, exploded_units, scannable, with_skip_reason
from ..functions.scalars import grade, month_of
from ..operators import clusters as C
from ..operators import history as H
from ..operators import pairs as P
from ..scratch import materialize
from ..sources import git
from .config import Config


def pick_snapshots(log: DataFrame, most: int = K.MAX_SNAPSHOTS) -> DataFrame:
    """``n, commit, month``: the last commit of each month, evenly thinned out; of a repository younger than six months
    evenly spaced commits, twelve at most."""
    rows = log.withColumn("repo", F.lit(0)).withColumn("month", month_of(F.col("ts")))
    months = materialize(H.month_last(rows, group="repo", order="n", month=F.col("month")), "months")
    if months.count() < K.YOUNG_MONTHS:
        return H.evenly_spaced(rows, group="repo", order="n", most=min(most, K.YOUNG_SNAPSHOTS)).select("n", "commit", "month")
    return H.evenly_spaced(months, group="repo", order="n", most=most).select("n", "commit", "month")


def series(spark: SparkSession, repo: str, snapshots: DataFrame, config: Config = Config()) -> DataFrame:
    """``n, commit, date, slop_percent, significant_lines, functions`` a snapshot.

    The snapshot is part of every key: units of one snapshot and language are compared among themselves, in the same joins for
    all. A blob is analysed once a language, whatever the number of paths and snapshots it stands under.
    """
    tree = git.trees(repo, snapshots.select("commit").repartition(4 * spark.sparkContext.defaultParallelism)).withColumn("size", F.lit(0))
    tree = scannable(tree, default_excludes=config.default_excludes, skip_tests=config.skip_tests)
    for glob in config.excludes:
        from .check import _glob

        tree = tree.where(~F.col("file").rlike(_glob(glob)))
    tree = materialize(tree.select("commit", "oid", "file", "lang", "is_test"), "trees")
    todo = tree.select("oid", "lang").distinct().repartition(4 * spark.sparkContext.defaultParallelism)
    text = with_skip_reason(git.blobs(repo, todo, K.MAX_FILE_BYTES)).where("skip is null").select(F.concat_ws(":", "oid", "lang").alias("key"), "lang", F.lit(False).alias("is_test"), "content")
    done = materialize(analysed(text, min_tokens=config.min_tokens).select(F.split("key", ":")[0].alias("oid"), "lang", "sig_lines", "units"), "blobs")
    placed = tree.join(done, ["oid", "lang"])
    lines = placed.groupBy("commit").agg(F.sum("sig_lines").cast("long").alias("significant_lines"), F.sum(F.size("units")).cast("int").alias("functions"))
    units = exploded_units(placed.withColumn("key", F.col("file")).withColumnRenamed("is_test", "test_path"), "units", "commit", "test_path")
    units = units.withColumn("is_test", F.col("is_test") | F.col("test_path")).withColumn("lang", F.concat_ws(":", "commit", "lang"))
    units = materialize(P.cull(materialize(units, "snapshot-units")), "culled")
    members = materialize(C.ranked_members(units, P.similar_links(units, config.bound(K.SCAN_THRESHOLD))), "members")
    owner = members.where("representative").select("cluster", "commit")
    rows = C.cluster_rows(members).join(owner, "cluster").where(~F.col("trait_impl_only") & (F.lit(config.include_tests) | ~F.col("test_only")))
    deletable = rows.groupBy("commit").agg(F.sum("deletable_lines").alias("deletable"))
    out = snapshots.join(lines, "commit", "left").join(deletable, "commit", "left")
    total = F.coalesce("significant_lines", F.lit(0))
    return out.select("n", F.substring("commit", 1, 10).alias("commit"), F.col("month").alias("date"),
                      F.when(total > 0, F.coalesce("deletable", F.lit(0)) * 100.0 / total).otherwise(F.lit(0.0)).alias("slop_percent"), total.alias("significant_lines"), F.coalesce("functions", F.lit(0)).alias("functions"))


def history(spark: SparkSession, path: str, config: Config = Config(), most: int = K.MAX_SNAPSHOTS) -> dict | None:
    """The report: ``repo, series, growth_factor, growth_since, current_grade``; None with fewer than two snapshots."""
    repo = git.repo_root(path)
    snapshots = materialize(pick_snapshots(git.log(spark, repo), most), "snapshots")
    if snapshots.count() < 2:
        return None
    points = materialize(series(spark, repo, snapshots, config), "series")
    grown = H.inflection(points.withColumn("repo", F.lit(0)), group="repo", order="n", value="slop_percent", date="date").first()
    rows = points.withColumn("grade", grade(F.col("slop_percent"))).orderBy("n").collect()  # as many as snapshots
    return {"schema_version": K.JSON_SCHEMA, "repo": os.path.basename(repo), "series": [{k: r[k] for k in ("commit", "date", "slop_percent", "significant_lines", "functions")} for r in rows],
            "growth_factor": grown.growth_factor, "growth_since": grown.growth_since, "current_grade": rows[-1].grade}
