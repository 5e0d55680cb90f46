"""Checking changed code against a base: hunks, the units they touch, what they duplicate, and what is no finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scalars import jaccard


def parse_hunks(lines: DataFrame, *, diff: str = "diff", order: str = "n", text: str = "line") -> DataFrame:
    """``diff, path, start, end`` of the new side's ranges in the lines of unified diffs without context.

    ``lines`` has one row a line of a diff. A hunk belongs to the last ``+++ b/`` line above it; after ``+++ /dev/null`` hunks count
    for nothing. A hunk without a length has one line, one of length 0 is dropped.
    """
    above = Window.partitionBy(diff).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    line = F.col(text)
    target = F.when(line.startswith("+++ /dev/null"), F.lit("")).when(line.startswith("+++ b/"), F.regexp_replace(F.substring(line, 7, 1 << 20), r"\t.*$|\s+$", ""))
    at = r"^@@ [^+]*\+(\d+)(?:,(\d+))?"
    marked = lines.withColumn("_path", F.last(target, ignorenulls=True).over(above)).where(line.startswith("@@ ") & line.rlike(at) & (F.coalesce("_path", F.lit("")) != ""))
    start, length = F.regexp_extract(line, at, 1).cast("int"), F.coalesce(F.regexp_extract(line, at, 2).try_cast("int"), F.lit(1))
    return marked.select(diff, F.col("_path").alias("path"), start.alias("start"), length.alias("len")).where("len > 0").select(diff, "path", "start", (F.col("start") + F.col("len") - 1).alias("end"))


def touched(units: DataFrame, hunks: DataFrame) -> DataFrame:
    """Units (``file, start_line, end_line``) that share a line with a hunk (``path, start, end``) of their file: a semi-join."""
    near = (F.col("u.file") == F.col("h.path")) & (F.col("u.start_line") <= F.col("h.end")) & (F.col("h.start") <= F.col("u.end_line"))
    return units.alias("u").join(hunks.alias("h"), near, "left_semi")


def without_same_function(matches: DataFrame) -> DataFrame:
    """Drops matches of a function with its own earlier self: the same file and name."""
    return matches.where(~F.coalesce((F.col("file") == F.col("original_file")) & (F.col("name") == F.col("original_name")), F.lit(False)))


def without_moves(matches: DataFrame, new_units: DataFrame, changed_files: DataFrame, bound: float = K.MOVE_EQUIVALENCE) -> DataFrame:
    """Drops matches whose original was taken out of its file: the file changed too, and no unit of its new version is
    similar to the original to at least ``bound``.

    ``matches`` has one row a ``unit_id``, with ``original_file, original_fps``; ``new_units(file, fps)`` are the units of changed files as they are now,
    ``changed_files(file)`` names those.
    """
    now = new_units.select(F.col("file").alias("original_file"), F.col("fps").alias("_now"))
    alive = matches.select("unit_id", "original_file", "original_fps").join(now, "original_file").where(jaccard(F.col("original_fps"), F.col("_now")) >= bound).select("unit_id").distinct()
    changed = changed_files.select(F.col("file").alias("original_file")).distinct().withColumn("_changed", F.lit(True))
    return (matches.join(changed, "original_file", "left").join(alive.withColumn("_alive", F.lit(True)), "unit_id", "left")
            .where(F.col("_changed").isNull() | F.col("_alive").isNotNull()).drop("_changed", "_alive"))


def finding_order() -> list[Column]:
    return [F.asc("file"), F.asc("line")]
