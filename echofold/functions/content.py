"""What the content of a file says: line counts and reasons to skip it. Lines end in ``\\n`` or ``\\r\\n``; null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def lines(content: Column) -> Column:
    """Lines without their ends; a final end opens no further line. An empty text has none."""
    parts = F.split(content, "\r?\n")
    return F.when(content == "", F.array().cast("array<string>")).when(content.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def is_generated(content: Column) -> Column:
    """A mark within the first lines, in any letter case."""
    head = F.lower(F.array_join(F.slice(lines(content), 1, K.GENERATED_HEAD), "\n"))
    marked = F.lit(False)
    for mark in K.GENERATED_MARKS:
        marked = marked | head.contains(mark)
    return marked


def is_minified(content: Column) -> Column:
    """A line beyond 2,000 bytes, or 300 and more bytes a line on the (whole-number) average."""
    rows = lines(content)
    total = F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    return F.exists(rows, lambda x: F.octet_length(x) > K.MINIFIED_LINE) | ((F.size(rows) > 0) & (F.floor(total / F.size(rows)) > K.MINIFIED_MEAN))


def skip_reason(content: Column) -> Column:
    """``generated``, ``minified`` or null; a null content (that can't be read as text) is ``non-utf8``."""
    return F.when(content.isNull(), "non-utf8").when(is_generated(content), "generated").when(is_minified(content), "minified")
