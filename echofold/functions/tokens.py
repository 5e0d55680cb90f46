"""Token streams of plain text, within a row.

Every step is a column of its own: an expression that a lambda function refers to would be evaluated again for each
element. Fingerprints of text are in ``operators.fingerprints``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case; null and empty give an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def named(tokens: Column) -> Column:
    """Words with the numbers among them as NUM."""
    return F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]+$"), "NUM").otherwise(t))


def collapsed(codes: Column) -> Column:
    """A run of NUM counts once; words stay however often they come."""
    before = F.concat(F.array(F.lit("")), codes)
    both = F.filter(F.arrays_zip(codes.alias("t"), F.slice(before, F.lit(1), F.size(codes)).alias("p")), lambda x: ~((x["t"] == "NUM") & (x["p"] == "NUM")))
    return F.transform(both, lambda x: x["t"])


def tokenised(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``id, words, codes`` of each document."""
    return docs.select(F.col(id).alias("id"), words(F.col(text)).alias("words")).select("id", "words", named(F.col("words")).alias("n")).select("id", "words", collapsed(F.col("n")).alias("codes"))
