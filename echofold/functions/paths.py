"""What the path of a file says: language, test, excluded. Column expressions on paths with ``/``; null gives null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _any(*words: str) -> str:
    return "|".join(re.escape(w) for w in words)


# One regular expression a predicate, shared with the driver-side walker and DuckDB (all three engines read it alike).
EXCLUDED_RE = rf"(^|/)({_any(*K.EXCLUDED_DIRS)})(/|$)|({_any(*K.EXCLUDED_SUFFIXES)})$|{re.escape(K.EXCLUDED_INFIX)}[^/]*$"
TEST_RE = (rf"(^|/)({_any(*K.TEST_DIRS)})(/|$)|({_any(*K.TEST_SUFFIXES)})$|(^|/)({_any(*K.TEST_NAMES)})$"
           rf"|(^|/)({_any(*K.TEST_PREFIXES)})[^/]*$|({_any(*K.TEST_INFIXES)})[^/]*$")


def extension(path: Column) -> Column:
    """What follows the last dot; the whole path where there is none."""
    return F.element_at(F.split(path, r"\."), -1)


def lang_of(path: Column) -> Column:
    """Language by extension, case-sensitive; null for others. A path without a dot counts as its own extension."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in K.EXTENSIONS.items() for x in pair]), extension(path))


def default_excluded(path: Column) -> Column:
    return F.lower(path).rlike(EXCLUDED_RE)


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(TEST_RE)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def py_lang(path: str) -> str | None:
    return K.EXTENSIONS.get(path.rsplit(".", 1)[-1])


def py_excluded(path: str) -> bool:
    return re.search(EXCLUDED_RE, path.lower()) is not None


def py_is_test(path: str) -> bool:
    return re.search(TEST_RE, path.lower()) is not None
