"""Small column functions of reports: grades, bars, numbers, import lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def grade(percent: Column) -> Column:
    """A to F; null gives null."""
    out = F.when(percent.isNull(), F.lit(None))
    for bound, letter in K.GRADES:
        out = out.when(percent < bound, letter)
    return out.otherwise(K.LAST_GRADE)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets given as arrays without repeats; 0 where both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)


def sim_bar(similarity: Column) -> Column:
    """Nine cells in eighths; null gives null."""
    eighths = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity)) * 72 + 0.5).cast("int")
    full = F.floor(eighths / 8).cast("int")
    rest = F.element_at(F.array(*[F.lit(x) for x in K.BAR_EIGHTHS]), eighths % 8 + 1)
    return F.when(similarity.isNotNull(), F.concat(F.repeat(F.lit("█"), full), F.when(full < 9, rest).otherwise("")))


def group_digits(n: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(n.cast("long"), 0)


def human_ms(ms: Column) -> Column:
    """Milliseconds as they are below a second, else seconds to one decimal."""
    return F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit("ms"))).when(ms >= 1000, F.concat(F.format_string("%.1f", ms / 1000.0), F.lit("s")))


def truncate(s: Column, most: int) -> Column:
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, max(0, most - 1)), F.lit("…")))


def truncate_left(s: Column, most: int) -> Column:
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.lit("…"), F.right(s, F.lit(max(0, most - 1)))))


def month_of(seconds: Column) -> Column:
    """UTC month (``YYYY-MM``) of a Unix time, whatever the session's zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM")


def _drop_last(parts: Column, when: Column) -> Column:
    return F.when(when, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def rust_use(file: Column, name: Column) -> Column:
    """``use crate::a::b::name;``: what follows the last ``src``, without a final mod, lib or main. Null unless a ``.rs`` file."""
    parts = F.split(F.regexp_replace(file, r"\.rs$", ""), "/")
    backwards = F.array_position(F.reverse(parts), "src")
    after = F.when(backwards > 0, F.slice(parts, (F.size(parts) - backwards + 2).cast("int"), F.greatest(F.lit(0), (backwards - 1)).cast("int"))).otherwise(parts)
    path = F.array_join(_drop_last(after, (F.size(after) > 0) & F.element_at(F.reverse(F.concat(F.array(F.lit("")), after)), 1).isin("mod", "lib", "main")), "::")
    return F.when(file.endswith(".rs"), F.concat(F.lit("use crate::"), F.when(path == "", "").otherwise(F.concat(path, F.lit("::"))), name, F.lit(";")))


def python_import(file: Column, name: Column) -> Column:
    """``from a.b import name``: without a leading src and a final __init__. Null unless a ``.py`` or ``.pyi`` file, or if no module is left."""
    parts = F.split(F.regexp_replace(file, r"\.pyi?$", ""), "/")
    body = F.when(F.element_at(parts, 1) == "src", F.slice(parts, 2, F.size(parts))).otherwise(parts)
    dotted = F.array_join(_drop_last(body, (F.size(body) > 0) & (F.element_at(F.reverse(F.concat(F.array(F.lit("")), body)), 1) == "__init__")), ".")
    return F.when(file.rlike(r"\.pyi?$") & (dotted != ""), F.concat(F.lit("from "), dotted, F.lit(" import "), name))


def relative_module(from_file: Column, target: Column) -> Column:
    """Module path of ``target`` (without extension) seen from the directory of ``from_file``; begins with ``./`` or ``..``."""
    here = F.split(from_file, "/")
    here = F.slice(here, 1, F.size(here) - 1)
    there = F.split(F.regexp_replace(target, r"\.[^./]*$", ""), "/")
    most = F.least(F.size(here), F.size(there) - 1)
    differ = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: (i <= most) & (F.get(here, i - 1) != F.get(there, i - 1)))
    common = F.when(F.size(differ) > 0, F.element_at(F.concat(differ, F.array(F.lit(0))), 1) - 1).otherwise(F.greatest(most, F.lit(0)))
    up = F.array_repeat(F.lit(".."), F.size(here) - common)
    path = F.array_join(F.concat(up, F.slice(there, common + 1, F.size(there))), "/")
    return F.when(path.startswith(".."), path).otherwise(F.concat(F.lit("./"), path))


def import_suggestion(lang: Column, original_file: Column, original_name: Column, from_file: Column) -> Column:
    """The line that brings the original into scope, for languages where a path and a name suffice; else null."""
    ts = F.concat(F.lit("import { "), original_name, F.lit(" } from '"), relative_module(from_file, original_file), F.lit("';"))
    return F.when(lang == "rust", rust_use(original_file, original_name)).when(lang == "python", python_import(original_file, original_name)).when(lang.isin("typescript", "tsx", "javascript"), ts)
