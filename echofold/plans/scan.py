"""Scanning a whole tree: files to units, pairs, clusters and a score; every step a named DataFrame."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..extract.units import analysed, exploded_units, scannable, with_skip_reason
from ..operators import clusters as C
from ..operators import pairs as P
from ..scratch import materialize, spread
from .config import Config


@dataclass
class Scan:
    """``files(file, size, content)`` and everything derived from it; a row that comes again counts once. What several results need is
    written once."""

    files: DataFrame
    config: Config = Config()
    shapes: bool = False
    began: float = field(default_factory=time.monotonic)

    def elapsed_ms(self) -> int:
        """Since the scan was set up."""
        return int((time.monotonic() - self.began) * 1000)

    @cached_property
    def analysis(self) -> DataFrame:
        """``key, lang, skip, sig_lines, total_lines, units, shapes`` of every scanned file."""
        rows = with_skip_reason(spread(scannable(self.files, default_excludes=self.config.default_excludes, skip_tests=self.config.skip_tests), "file")).withColumnRenamed("file", "key")
        rows = rows.withColumn("text", F.xxhash64("content")).withColumn("content", F.when(F.col("skip").isNull(), F.col("content")))
        done = analysed(rows, min_tokens=self.config.min_tokens, shapes=self.shapes, keep=("skip", "text"))
        # repeated rows of a file are dropped by what came out, so that content is never shuffled for it
        return materialize(done.dropDuplicates(["key", "text"]).drop("text"), "analysis")

    @cached_property
    def units(self) -> DataFrame:
        return materialize(exploded_units(self.analysis.where("skip is null")), "units")

    @cached_property
    def culled(self) -> DataFrame:
        return materialize(P.cull(self.units), "culled")

    @cached_property
    def links(self) -> DataFrame:
        """Similar pairs of class representatives, and copies with theirs."""
        return P.similar_links(self.culled, self.config.bound(K.SCAN_THRESHOLD))

    @cached_property
    def members(self) -> DataFrame:
        return materialize(C.ranked_members(self.culled, self.links), "members")

    @cached_property
    def clusters(self) -> DataFrame:
        return C.cluster_rows(self.members)

    @cached_property
    def stats(self) -> dict:
        n = lambda r: F.count_if(F.col("skip") == r).alias("skipped_" + r.replace("-", "_"))
        row = self.analysis.agg(F.count_if(F.col("skip").isNull()).alias("files"), F.coalesce(F.sum("total_lines"), F.lit(0)).alias("total_lines"), F.coalesce(F.sum("sig_lines"), F.lit(0)).alias("significant_lines"),
                                F.coalesce(F.sum(F.size("units")), F.lit(0)).alias("functions"), n("generated"), n("minified"), n("non-utf8")).first().asDict()
        return {**{k: row[k] for k in ("files", "total_lines", "significant_lines", "functions")}, "elapsed_ms": self.elapsed_ms(), **{k: row[k] for k in ("skipped_generated", "skipped_minified", "skipped_non_utf8")}}

    @cached_property
    def score(self) -> dict:
        r = C.score(self.clusters, F.lit(self.stats["significant_lines"]), self.config.include_tests).first()
        return {"slop_percent": r.percent, "grade": r.grade, "deletable_lines": r.deletable_lines}

    @cached_property
    def containment(self) -> DataFrame:
        """``contained, container`` (structs of place and lines) and ``containment``: the strongest container of each unit."""
        best = P.best_container(P.containment_pairs(self.culled, self.config.bound(K.SCAN_THRESHOLD)))
        side = lambda as_, id: self.units.select(F.col("unit_id").alias(id), F.struct("file", "name", "start_line", "end_line", F.col("sig_lines").alias("lines")).alias(as_))
        return best.join(side("contained", "small"), "small").join(side("container", "large"), "large").select("contained", "container", "containment").orderBy(
            F.desc("contained.lines"), F.desc("containment"), "contained.file", "contained.start_line")

    @cached_property
    def shape_members(self) -> DataFrame:
        """Members of clusters of class shapes; frequent signatures are culled as fingerprints are."""
        units = materialize(P.cull(exploded_units(self.analysis.where("skip is null"), "shapes")), "shapes")
        return materialize(C.ranked_members(units, P.similar_links(units, self.config.bound(K.SCAN_THRESHOLD))), "shape-members")
