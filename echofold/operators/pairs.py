"""Set-similarity joins of units: cull of frequent fingerprints, candidates, Jaccard and containment pairs, probes.

Units are ``unit_id bigint, lang string, fps array<bigint>`` and further columns. Every join has the form of an equi-join
on (lang, fp). The exact joins look at the rarest fingerprints of a set only: two sets whose similarity reaches a bound
have one of those in common (prefix filter), so that frequent fingerprints meet nobody, and candidates are verified on
the whole sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..scratch import small


def exploded(units: DataFrame) -> DataFrame:
    """``unit_id, lang, fp``; null languages and null or empty sets give no rows."""
    return units.where("lang is not null").select("unit_id", "lang", F.explode("fps").alias("fp"))


def frequencies(units: DataFrame) -> DataFrame:
    """``lang, fp, df``: in how many units of its language a fingerprint occurs."""
    return exploded(units).groupBy("lang", "fp").agg(F.count(F.lit(1)).alias("df"))


def cull_caps(units: DataFrame, floor: int = K.CULL_FLOOR, share: int = K.CULL_SHARE) -> DataFrame:
    """``lang, cap``: a language's bound, of all its units, with fingerprints or not."""
    return units.where("lang is not null").groupBy("lang").agg(F.greatest(F.lit(floor), F.floor(F.count(F.lit(1)) / share)).cast("long").alias("cap"))


def hot_fingerprints(units: DataFrame, floor: int = K.CULL_FLOOR, share: int = K.CULL_SHARE) -> DataFrame:
    """``lang, fp, df`` of the fingerprints beyond their language's bound. With an average set of m they are fewer than
    ``share * m`` a language, however many units there are."""
    return frequencies(units).join(small(cull_caps(units, floor, share)), "lang").where("df > cap").select("lang", "fp", "df")


def cull(units: DataFrame, floor: int = K.CULL_FLOOR, share: int = K.CULL_SHARE) -> DataFrame:
    """Units with their hot fingerprints taken out of ``fps``; other columns stay.

    A language's hot fingerprints are one array (of bounded length, see ``hot_fingerprints``) on the unit's row, so that
    sets are neither exploded nor shuffled.
    """
    hot = hot_fingerprints(units, floor, share).groupBy("lang").agg(F.collect_list("fp").alias("_hot"))
    return units.join(small(hot), "lang", "left").withColumn("fps", F.when(F.col("_hot").isNull(), F.col("fps")).otherwise(F.array_except("fps", "_hot"))).drop("_hot")


def _rarest_first(units: DataFrame) -> DataFrame:
    """``unit_id, lang, fps`` with each set in order of frequency, then value."""
    df = frequencies(units)
    return (
        exploded(units).join(df, ["lang", "fp"]).groupBy("unit_id", "lang")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "fp"))), lambda x: x["fp"]).alias("fps"))
    )


def set_classes(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(members, reps)``: ``members(unit_id, rep)`` names, for every unit with a language and a non-empty set, the least unit with an
    equal set in its language; ``reps`` are the rows of those. Copies are one class, so that a join never expands them.

    Sets are told apart by 128 bits of hash and counted with map-side combine: a class may hold any share of the units.
    """
    keyed = units.where(F.col("lang").isNotNull() & (F.size("fps") > 0)).withColumn("fps", F.array_sort("fps"))
    keyed = keyed.withColumn("_k1", F.xxhash64("lang", "fps")).withColumn("_k2", F.xxhash64("fps", F.lit(3), "lang"))
    least = keyed.groupBy("_k1", "_k2").agg(F.min("unit_id").alias("rep"))
    members = keyed.select("unit_id", "_k1", "_k2").join(least, ["_k1", "_k2"]).select("unit_id", "rep")
    return members, keyed.drop("_k1", "_k2").join(least.select(F.col("rep").alias("unit_id")), "unit_id", "left_semi")


def similar_links(units: DataFrame, threshold: float = K.SCAN_THRESHOLD, min_shared: int = K.MIN_SHARED) -> DataFrame:
    """``a, b``: what connects similar units, without a link for every pair: the similar pairs of class representatives, and each other
    member of a class with its representative. A set of fewer than ``min_shared`` values links nothing."""
    members, reps = set_classes(units.where(F.size("fps") >= min_shared))
    return jaccard_pairs(reps, threshold, min_shared).select("a", "b").unionByName(members.where("unit_id <> rep").select(F.col("rep").alias("a"), F.col("unit_id").alias("b")))


def _needed(size: Column, bound: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(size * bound - 1e-9)).cast("int")


def _verified(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, shared, na, nb``."""
    a = sets.select(F.col("unit_id").alias("a"), F.col("fps").alias("fa"))
    b = sets.select(F.col("unit_id").alias("b"), F.col("fps").alias("fb"))
    return candidates.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("fa", "fb")).alias("shared"), F.size("fa").alias("na"), F.size("fb").alias("nb"))


def jaccard_pairs(units: DataFrame, threshold: float = K.SCAN_THRESHOLD, min_shared: int = K.MIN_SHARED) -> DataFrame:
    """``a, b, shared, similarity`` (a < b) of the pairs of one language with at least ``min_shared`` fingerprints in common
    and Jaccard similarity of at least ``threshold``; exact. For a threshold of 0 use ``candidate_pairs``."""
    sets = _rarest_first(units)
    size = F.size("fps")
    prefix = sets.where(size >= min_shared).select("unit_id", "lang", size.alias("n"), F.explode(F.slice("fps", F.lit(1), size - _needed(size, threshold) + 1)).alias("fp"))
    x, y = prefix.alias("x"), prefix.alias("y")
    candidates = x.join(y, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.fp") == F.col("y.fp")) & (F.col("x.unit_id") < F.col("y.unit_id"))
                        & (F.col("x.n") >= F.col("y.n") * threshold - 1e-9) & (F.col("y.n") >= F.col("x.n") * threshold - 1e-9)).select(F.col("x.unit_id").alias("a"), F.col("y.unit_id").alias("b")).distinct()
    return (_verified(candidates, sets).where(F.col("shared") >= min_shared)
            .select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("similarity")).where(F.col("similarity") >= threshold))


def candidate_pairs(units: DataFrame, min_shared: int = K.MIN_SHARED) -> DataFrame:
    """``a, b, shared`` (a < b) of all pairs of one language with at least ``min_shared`` in common. Meant for culled units:
    its work grows with the square of the bound."""
    x, y = exploded(units).alias("x"), exploded(units).alias("y")
    return (x.join(y, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.fp") == F.col("y.fp")) & (F.col("x.unit_id") < F.col("y.unit_id")))
            .groupBy(F.col("x.unit_id").alias("a"), F.col("y.unit_id").alias("b")).agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= min_shared))


def containment_pairs(units: DataFrame, threshold: float = K.SCAN_THRESHOLD, contained: float = K.CONTAINMENT, min_shared: int = K.MIN_SHARED, members: DataFrame | None = None) -> DataFrame:
    """``small, large, containment``: pairs below the similarity threshold of which the smaller set (a tie: the smaller id) lies
    to at least ``contained`` in the larger. Units with ``file_id, start_byte, end_byte`` lexically inside each other are left out.
    With ``members`` (``unit_id, rep`` and the place) the units stand for classes: a pair is left out if each member of one lies inside
    or around each of the other."""
    sets = _rarest_first(units)
    size = F.size("fps")
    # the small set's rarest fingerprints meet all of a larger set's; one of them must be there
    probe = sets.where(size >= min_shared).select(F.col("unit_id").alias("small"), "lang", size.alias("n"), F.explode(F.slice("fps", F.lit(1), size - _needed(size, contained) + 1)).alias("fp"))
    post = sets.select(F.col("unit_id").alias("large"), "lang", size.alias("m"), F.explode("fps").alias("fp"))
    candidates = probe.join(post, ["lang", "fp"]).where("n < m or (n = m and small < large)").select(F.col("small").alias("a"), F.col("large").alias("b")).distinct()
    ratio = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    found = (_verified(candidates, sets).where((F.col("shared") >= min_shared) & (ratio < threshold))
             .select(F.col("a").alias("small"), F.col("b").alias("large"), (F.col("shared") / F.col("na")).alias("containment")).where(F.col("containment") >= contained))
    place = lambda p: units.select(F.col("unit_id").alias(p), F.col("file_id").alias(p + "_file"), F.col("start_byte").alias(p + "_from"), F.col("end_byte").alias(p + "_to"))
    inside = lambda i, o: (F.col(i + "_from") >= F.col(o + "_from")) & (F.col(i + "_to") <= F.col(o + "_to"))
    nested = (F.col("small_file") == F.col("large_file")) & (inside("small", "large") | inside("large", "small"))
    placed = found.join(place("small"), "small").join(place("large"), "large").withColumn("nested", F.coalesce(nested, F.lit(False)))
    if members is None:
        return placed.where("not nested").select("small", "large", "containment")
    # only pairs whose representatives are nested are looked at by members, and only if both classes lie in one and the same file
    spread = members.groupBy("rep").agg(F.min("file_id").alias("f"), (F.count("file_id") == F.count(F.lit(1))).alias("known"), F.max("file_id").alias("g"), F.count(F.lit(1)).alias("n")).where("known and f = g")
    one = lambda p: spread.select(F.col("rep").alias(p), F.col("f").alias(p + "_f"), F.col("n").alias(p + "_n"))
    open_ = placed.where("nested").select("small", "large").join(one("small"), "small").join(one("large"), "large").where("small_f = large_f").select("small", "large", F.col("small_n"), F.col("large_n"))
    spot = lambda p: members.select(F.col("rep").alias(p), F.col("start_byte").alias(p + "_from"), F.col("end_byte").alias(p + "_to"))
    each = open_.join(spot("small"), "small").join(spot("large"), "large")
    dropped = (each.groupBy("small", "large").agg(F.count_if(F.coalesce(inside("small", "large") | inside("large", "small"), F.lit(False))).alias("k"), F.max("small_n").alias("i"), F.max("large_n").alias("j"))
               .where("k = i * j").select("small", "large"))
    return placed.join(dropped, ["small", "large"], "left_anti").select("small", "large", "containment")


def best_container(pairs: DataFrame) -> DataFrame:
    """One row a contained unit: its greatest containment (ties: the least container id)."""
    best = F.max(F.struct("containment", (-F.col("large")).alias("minus")))
    return pairs.groupBy("small").agg(best.alias("best")).select("small", (-F.col("best.minus")).alias("large"), F.col("best.containment").alias("containment"))


def probe_pairs(changed: DataFrame, base: DataFrame, threshold: float = K.CHECK_THRESHOLD) -> DataFrame:
    """``unit_id, original_id, similarity``: the most similar base unit of each changed one, if it reaches ``threshold`` (ties:
    the least id). Within a language; nothing is culled and one shared fingerprint is enough to be compared. Copies are
    compared once on either side."""
    asked, new = set_classes(changed)
    _, old = set_classes(base)
    sides = new.select("unit_id", "lang", "fps", F.lit(0).alias("side")).unionByName(old.select("unit_id", "lang", "fps", F.lit(1).alias("side")))
    df = frequencies(sides)
    size = F.size("fps")
    ordered = (sides.select("unit_id", "side", "lang", F.explode("fps").alias("fp")).join(df, ["lang", "fp"]).groupBy("unit_id", "side", "lang")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "fp"))), lambda x: x["fp"]).alias("fps")))
    prefix = ordered.select("unit_id", "side", "lang", size.alias("n"), F.explode(F.slice("fps", F.lit(1), size - _needed(size, threshold) + 1)).alias("fp"))
    theirs = prefix.where("side = 1").select(F.col("unit_id").alias("original_id"), "lang", "fp", F.col("n").alias("m"))
    found = prefix.where("side = 0").join(theirs, ["lang", "fp"]).where((F.col("n") >= F.col("m") * threshold - 1e-9) & (F.col("m") >= F.col("n") * threshold - 1e-9)).select("unit_id", "original_id").distinct()
    sets = old.select(F.col("unit_id").alias("original_id"), F.col("fps").alias("theirs"))
    shared = F.size(F.array_intersect("fps", "theirs"))
    scored = found.join(new.select("unit_id", "fps"), "unit_id").join(sets, "original_id").select("unit_id", "original_id", (shared / (F.size("fps") + F.size("theirs") - shared)).alias("similarity"))
    best = F.max(F.struct("similarity", (-F.col("original_id")).alias("minus")))
    answers = scored.where(F.col("similarity") >= threshold).groupBy("unit_id").agg(best.alias("best")).withColumnRenamed("unit_id", "rep")
    return asked.join(answers, "rep").select("unit_id", (-F.col("best.minus")).alias("original_id"), F.col("best.similarity").alias("similarity"))
