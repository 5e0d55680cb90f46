"""Checking the changes of a repository against its base revision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..extract.units import analysed, exploded_units, scannable, with_skip_reason
from ..functions import paths as P
from ..functions.scalars import import_suggestion
from ..operators import check as O
from ..operators.pairs import probe_pairs
from ..scratch import materialize
from ..sources import git
from .config import Config

FINDING = ("file", "line", "name", "similarity", "original_file", "original_line", "original_name", "suggestion")


@dataclass
class Outcome:
    had_changes: bool
    findings: DataFrame | None


def find(changed: DataFrame, base: DataFrame, now: DataFrame, threshold: float) -> DataFrame:
    """Findings of changed units against a base: the best match of each, without the same function and without moved ones.

    All three have the columns of units; ``now`` are all units of the changed files as they are now, ``changed`` those of them that were
    touched. One row a finding, in order of file and line.
    """
    best = probe_pairs(changed, base, threshold)
    mine = changed.select("unit_id", "file", "name", F.col("start_line").alias("line"))
    theirs = base.select(F.col("unit_id").alias("original_id"), F.col("file").alias("original_file"), F.col("name").alias("original_name"), F.col("start_line").alias("original_line"), F.col("fps").alias("original_fps"))
    found = O.without_same_function(best.join(mine, "unit_id").join(theirs, "original_id"))
    return found


def check(spark: SparkSession, path: str, config: Config = Config(), revision: str | None = None) -> Outcome:
    """Findings of what changed: since the merge base with ``revision``, or staged, or in the working tree.

    Languages are compared among themselves, nothing is culled, test files are left out on both sides, and exclusions
    hold on both sides if they hold at all.
    """
    repo = git.repo_root(path)
    mode, base_commit, diff, untracked = git.changes(repo, revision)
    lines = spark.createDataFrame([(0, i, line) for i, line in enumerate(diff.splitlines())], "diff int, n int, line string")
    hunks = O.parse_hunks(lines).select("path", "start", "end")
    if untracked:
        hunks = hunks.unionByName(spark.createDataFrame([(x, 1, 2**31 - 1) for x in untracked], "path string, start int, end int"))
    hunks = materialize(hunks, "hunks")
    if not hunks.take(1):
        return Outcome(False, None)

    def units(rows: DataFrame, name: str) -> DataFrame:
        kept = with_skip_reason(rows).where("skip is null").withColumnRenamed("file", "key")
        return materialize(exploded_units(analysed(kept, min_tokens=config.min_tokens)), name)

    def wanted(rows: DataFrame) -> DataFrame:
        rows = scannable(rows, default_excludes=config.default_excludes, skip_tests=True)
        for glob in config.excludes:
            rows = rows.where(~F.col("file").rlike(_glob(glob)))
        return rows

    tree = wanted(git.trees(repo, spark.createDataFrame([(base_commit,)], "commit string")).withColumn("size", F.lit(0)))
    base = units(git.blobs(repo, tree.select("oid", "file", "lang", "is_test").repartition(4 * spark.sparkContext.defaultParallelism), K.MAX_FILE_BYTES), "base-units")
    files = hunks.select(F.col("path").alias("file")).distinct()
    now = units(wanted(git.new_side(repo, mode, files).withColumn("size", F.coalesce(F.octet_length("content"), F.lit(0)))), "new-units")
    # ids of the two sides must differ although file and span may not
    now = now.withColumn("unit_id", F.xxhash64("unit_id", F.lit("new")))
    found = find(O.touched(now, hunks), base, now, config.bound(K.CHECK_THRESHOLD))
    kept = O.without_moves(found, now.select("file", "fps"), files)
    out = kept.withColumn("suggestion", import_suggestion(P.lang_of(F.col("original_file")), F.col("original_file"), F.col("original_name"), F.col("file")))
    return Outcome(True, out.select(*FINDING).orderBy("file", "line"))


def _glob(glob: str) -> str:
    import fnmatch

    return "(^|/)" + fnmatch.translate(glob)
