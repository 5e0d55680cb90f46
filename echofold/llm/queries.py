"""The pN_ queries of this package; each takes (spark, directory of the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize
from ..sources.tables import comparable, table, unit_rows


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .setjoin import similar_records

    units = comparable(unit_rows(table(spark, sf_dir, "units"))).where("lang is not null")
    return similar_records(units, id="unit_id", group="lang", values="fps", theta=0.8).select("a", "b")


def _p1_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from .setjoin import similar_record_classes

    units = comparable(unit_rows(table(spark, sf_dir, "units"))).where("lang is not null")
    return similar_record_classes(units, id="unit_id", group="lang", values="fps", theta=0.8)


def p1_class_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similar pairs of p1 between classes of equal sets, each named by its least unit."""
    return _p1_classes(spark, sf_dir)[0].select("a", "b", F.round("similarity", 6).alias("similarity"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every comparable unit, and how many links it has to other classes."""
    links, members = _p1_classes(spark, sf_dir)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return members.select("rep", F.col("id").alias("unit_id")).join(degree, "rep", "left").select("unit_id", F.col("rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .authorship import not_hand_written

    return not_hand_written(table(spark, sf_dir, "files")).select("file_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .components import grouped

    return grouped(table(spark, sf_dir, "members"), table(spark, sf_dir, "pairs"), vertex="func")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .termfreq import term_verdicts

    units = materialize(unit_rows(table(spark, sf_dir, "units")).select("fps"), "unit-values")
    return term_verdicts(units, values="fps").select(F.col("value").alias("fingerprint"), "verdict")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fingerprint: how often it occurs, in how many units, and its verdict, if any."""
    from .termfreq import value_counts, with_verdict

    units = materialize(unit_rows(table(spark, sf_dir, "units"), "fingerprints").select("fingerprints"), "unit-values")
    return with_verdict(value_counts(units, values="fingerprints"), units, values="fingerprints").select(F.col("value").alias("fingerprint"), F.col("n").alias("occurrences"), F.col("records").alias("units"), "verdict")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .batches import judge_batches

    units = comparable(unit_rows(table(spark, sf_dir, "units")))
    return judge_batches(units, min_report=8).select("unit_id", "original_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import encoded

    return encoded(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "ids")


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and read back from its ids."""
    from .tokens import decoded, encoded

    return decoded(encoded(table(spark, sf_dir, "documents"))).select(F.col("id").alias("doc_id"), "text")


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a message (same message id, or the same text where it has none) don't share a container, nor does mail of a public
    list with that of private boxes."""
    from .packing import packed
    from .tokens import encoded

    documents = table(spark, sf_dir, "documents")
    sizes = encoded(documents, count=True).select(F.col("id").alias("doc_id"), "n")
    items = documents.select("doc_id", "source", F.coalesce("message_id", F.xxhash64("text").cast("string")).alias("cluster")).join(sizes, "doc_id")
    return packed(items, id="doc_id", size="n", source="source", cluster="cluster", apart=[{"list_archive", x} for x in ("mbox_export", "imap_sync", "eml_dump")]).withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents")).where("kind not in ('prose', 'empty')").select(F.col("id").alias("doc_id"))


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document."""
    from .quality import quality

    return quality(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_class_links, p1_classes, p2_found, p3_found, p4_found, p4_counts, p6_found, p7_ids, p7_decoded, p8_pack, p9_found, p9_stats)}
