"""Scoring a detector against known pairs: confusion, precision and recall, by kind, over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = unordered(F.col(a), F.col(b))
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(x.alias("a"), y.alias("b")).distinct()


def confusion(truth: DataFrame, predicted: DataFrame, items: int, *, a: str = "a", b: str = "b") -> DataFrame:
    """One row ``tp, fp, fn, tn`` over all pairs of ``items`` items; pairs are unordered, repeats and self-pairs don't count.

    The universe of pairs is counted, never built.
    """
    t, p = _pairs(truth, a, b).withColumn("t", F.lit(1)), _pairs(predicted, a, b).withColumn("p", F.lit(1))
    both = t.join(p, ["a", "b"], "full")
    n = lambda cond: F.count_if(cond).alias
    out = both.agg(n(F.col("t").isNotNull() & F.col("p").isNotNull())("tp"), n(F.col("t").isNull())("fp"), n(F.col("p").isNull())("fn"))
    return out.withColumn("tn", F.lit(items * (items - 1) // 2) - F.col("tp") - F.col("fp") - F.col("fn"))


def class_recall(members: DataFrame, similar: DataFrame, predicted: DataFrame, kind: str, *, a: str = "a", b: str = "b") -> DataFrame:
    """``kind, hit, total, recall`` where every two items of a class, and of two similar classes, are a true pair.

    ``members(unit_id, rep, kind)`` with one kind a class, ``similar(a, b)`` pairs of classes by their ``rep``. True pairs are
    counted from the sizes of the classes, never built; predicted ones are judged by the classes of their ends.
    """
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.first(kind).alias(kind))
    alike = _pairs(similar, "a", "b")
    side = lambda c: sizes.select(F.col("rep").alias(c), F.col("n").alias("n" + c), *([kind] if c == "a" else []))
    within = sizes.select(kind, F.expr("n * (n - 1) div 2").alias("total"))
    across = alike.join(side("a"), "a").join(side("b"), "b").select(kind, (F.col("na") * F.col("nb")).alias("total"))
    totals = within.unionByName(across).groupBy(kind).agg(F.sum("total").alias("total")).where("total > 0")
    end = lambda c: members.select(F.col("unit_id").alias(c), F.col("rep").alias("r" + c), *([kind] if c == "a" else []))
    x, y = unordered(F.col("ra"), F.col("rb"))
    judged = _pairs(predicted, a, b).join(end("a"), "a").join(end("b"), "b").select(x.alias("a"), y.alias("b"), kind)
    hits = judged.join(alike.withColumn("s", F.lit(1)), ["a", "b"], "left").where("a = b or s = 1").groupBy(kind).agg(F.count(F.lit(1)).alias("hit"))
    out = totals.join(hits, totals[kind].eqNullSafe(hits[kind]), "left").select(totals[kind], F.coalesce("hit", F.lit(0)).alias("hit"), "total")
    return out.withColumn("recall", F.col("hit") / F.col("total"))


def class_confusion(members: DataFrame, similar: DataFrame, predicted: DataFrame, items: int, *, a: str = "a", b: str = "b") -> DataFrame:
    """``confusion`` against the true pairs of ``class_recall``."""
    found = class_recall(members.select("unit_id", "rep", F.lit(0).alias("_kind")), similar, predicted, "_kind", a=a, b=b)
    total = found.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("tp"), F.coalesce(F.sum("total"), F.lit(0)).alias("true"))
    said = _pairs(predicted, a, b).agg(F.count(F.lit(1)).alias("said"))
    out = total.join(said).select("tp", (F.col("said") - F.col("tp")).alias("fp"), (F.col("true") - F.col("tp")).alias("fn"))
    return out.withColumn("tn", F.lit(items * (items - 1) // 2) - F.col("tp") - F.col("fp") - F.col("fn"))


def scores(conf: DataFrame) -> DataFrame:
    """Adds ``precision, recall, f1, mcc`` to rows of ``tp, fp, fn, tn``; 0 where a denominator is."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    out = conf.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return out.withColumn("mcc", ratio(tp * tn - fp * fn, root))


def recall_by(truth: DataFrame, predicted: DataFrame, kind: str, *, a: str = "a", b: str = "b") -> DataFrame:
    """``kind, hit, total, recall`` for each kind of true pair."""
    x, y = unordered(F.col(a), F.col(b))
    t = truth.select(x.alias("a"), y.alias("b"), kind).distinct()
    p = _pairs(predicted, a, b).withColumn("p", F.lit(1))
    return t.join(p, ["a", "b"], "left").groupBy(kind).agg(F.count("p").alias("hit"), F.count(F.lit(1)).alias("total")).withColumn("recall", F.col("hit") / F.col("total"))


def determinism(runs: DataFrame, *, run: str = "run", a: str = "a", b: str = "b") -> DataFrame:
    """One row ``runs, determinism``: the mean Jaccard similarity of the predicted pairs of every two runs; 1.0 for fewer than two.

    A pair's runs meet by a join on the pair; runs without any pair in common count 0, two empty ones can't be seen here.
    """
    x, y = unordered(F.col(a), F.col(b))
    p = runs.select(F.col(run).alias("run"), x.alias("a"), y.alias("b")).distinct()
    sizes = p.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    two = sizes.alias("p").join(sizes.alias("q"), F.col("p.run") < F.col("q.run")).select(F.col("p.run").alias("r"), F.col("q.run").alias("s"), F.col("p.n").alias("n"), F.col("q.n").alias("m"))
    shared = p.alias("p").join(p.alias("q"), (F.col("p.a") == F.col("q.a")) & (F.col("p.b") == F.col("q.b")) & (F.col("p.run") < F.col("q.run"))).groupBy(F.col("p.run").alias("r"), F.col("q.run").alias("s")).agg(F.count(F.lit(1)).alias("c"))
    each = two.join(shared, ["r", "s"], "left").select((F.coalesce("c", F.lit(0)) / (F.col("n") + F.col("m") - F.coalesce("c", F.lit(0)))).alias("j"))
    mean = each.agg(F.coalesce(F.avg("j"), F.lit(1.0)).alias("determinism"))
    one = lambda df: df.withColumn("_", F.lit(1))
    return one(sizes.agg(F.count(F.lit(1)).alias("runs"))).join(one(mean), "_").drop("_")


def run_summary(runs: DataFrame, *, group: str, values: list[str], cost: str | None = None, found: str | None = None) -> DataFrame:
    """Mean and sample deviation (0 for one run) of the values a group, nulls skipped; with ``cost`` and ``found`` the cost of a hit."""
    aggs = [x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.when(F.count(v) > 0, F.coalesce(F.when(F.count(v) > 1, F.stddev_samp(v)), F.lit(0.0))).alias(f"{v}_stddev"))]
    if cost and found:
        aggs.append(F.when(F.sum(found) > 0, F.sum(cost) / F.sum(found)).alias("cost_per_hit"))
    return runs.groupBy(group).agg(F.count(F.lit(1)).alias("runs"), *aggs)


def match_truth(reported: DataFrame, truth: DataFrame) -> DataFrame:
    """Reported members (``file, name``) with the id of the known function of the same file name and function name.

    ``truth(id, file, name)``; several known ones of a key: the least id. Members without a match keep a null id.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    known = truth.select(base(F.col("file")).alias("_base"), F.col("name"), F.col("id").alias("truth_id")).groupBy("_base", "name").agg(F.min("truth_id").alias("truth_id"))
    return reported.withColumn("_base", base(F.col("file"))).join(known, ["_base", "name"], "left").drop("_base")
