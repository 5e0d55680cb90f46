"""The driver's Parquet tables and their canonical forms.

Canonical means: one row an entity however often it was delivered, paths in the compared form, languages
trimmed and in lower case, fingerprint arrays as sorted sets without nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def compared_path(path: Column) -> Column:
    r"""``\`` becomes ``/``; leading ``./`` are dropped; letter case stays. Null stays null."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", "")


def clean_lang(lang: Column) -> Column:
    """Trimmed lower case; null stays null."""
    return F.lower(F.trim(lang))


def fingerprint_set(fps: Column) -> Column:
    """Sorted distinct non-null values; a null array becomes an empty one."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(fps, F.array().cast("array<bigint>")), lambda x: x.isNotNull())))


def unit_rows(units: DataFrame, *extra: str) -> DataFrame:
    """One row a unit: ``unit_id, lang, sig_lines, batch_no, fps`` and the ``extra`` columns.

    Repeats of a unit differ in the order of their fingerprints at most; should they differ in more, the
    row loaded last holds (ties: the greatest row). Rows without ``unit_id`` are no units and are dropped.
    The single shuffle is on ``unit_id``.
    """
    rest = [c for c in ("sig_lines", "batch_no", *extra)]
    row = F.struct(F.col("loaded_at"), clean_lang(F.col("lang")).alias("lang"), *rest, fingerprint_set(F.col("fingerprints")).alias("fps"))
    return (
        units.where(F.col("unit_id").isNotNull())
        .select("unit_id", row.alias("row"))
        .groupBy("unit_id")
        .agg(F.max("row").alias("row"))
        .select("unit_id", "row.lang", *[f"row.{c}" for c in rest], "row.fps")
    )


def comparable(units: DataFrame, min_lines: int = 5) -> DataFrame:
    """Units with a fingerprint and at least ``min_lines`` significant lines (null is not enough)."""
    return units.where((F.size("fps") > 0) & (F.col("sig_lines") >= min_lines))


def file_rows(files: DataFrame, *columns: str) -> DataFrame:
    """One row a file: ``file_id, file`` (compared path) and the asked columns; of several deliveries the last (ties: the
    greatest row). Only what is asked for travels: ask for ``content`` only where its text is needed."""
    row = F.struct(F.col("loaded_at"), compared_path(F.col("path")).alias("file"), *columns)
    return (files.where("file_id is not null").select("file_id", row.alias("row")).groupBy("file_id").agg(F.max("row").alias("row"))
            .select("file_id", "row.file", *[f"row.{c}" for c in columns]))


def placed_units(units: DataFrame, files: DataFrame) -> DataFrame:
    """Unit rows with the path of their file (null for units of unknown files) and all columns the cluster operators use."""
    rows = unit_rows(units, "file_id", "name", "start_line", "end_line", "start_byte", "end_byte", "is_test", "is_trait_impl_method")
    return rows.join(file_rows(files), "file_id", "left")
