"""Source trees as DataFrames: a walk that honours .gitignore, and content read by the executors."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths as P

FILE_SCHEMA = "file string, size long, content string"


def _rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """A .gitignore line as (pattern on the path below its directory, for directories only, negated)."""
    line = line.rstrip("\n")
    line = line if line.endswith("\\ ") else line.rstrip()
    if not line or line.startswith("#"):
        return None
    negated, line = line.startswith("!"), line.removeprefix("!")
    only_dirs, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.lstrip("/")
    out = ""
    i = 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + r"(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + r".*", i + 2
        elif line[i] == "*":
            out, i = out + r"[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + r"[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 1 :]:
            end = line.index("]", i + 1)
            out, i = out + "[" + line[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return re.compile(("" if anchored else r"(?:.*/)?") + out + r"\Z"), only_dirs, negated


def walk(root: str, *, default_excludes: bool = True, excludes: tuple[str, ...] = ()) -> Iterator[tuple[str, int]]:
    """(path below the root with ``/``, size) of the files of known languages, in order of path.

    Hidden entries, what .gitignore files say and, unless switched off, the default exclusions are left out; ``excludes`` are
    further globs on the path or the name.
    """
    def visit(rel: str, rules: list) -> Iterator[tuple[str, int]]:
        here = os.path.join(root, rel) if rel else root
        own = []
        try:
            with open(os.path.join(here, ".gitignore"), encoding="utf-8", errors="replace") as f:
                own = [r for r in map(_rule, f) if r]
        except OSError:
            pass
        rules = [*rules, (rel, own)]
        for entry in sorted(os.scandir(here), key=lambda e: e.name):
            if entry.name.startswith("."):
                continue
            path = f"{rel}/{entry.name}" if rel else entry.name
            is_dir = entry.is_dir(follow_symlinks=False)
            ignored = False
            for base, lines in rules:
                below = path[len(base) + 1 :] if base else path
                for pattern, only_dirs, negated in lines:
                    if (is_dir or not only_dirs) and pattern.match(below):
                        ignored = not negated
            if ignored or (default_excludes and P.py_excluded(path)) or any(fnmatch.fnmatch(path, g) or fnmatch.fnmatch(entry.name, g) for g in excludes):
                continue
            if is_dir:
                yield from visit(path, rules)
            elif entry.is_file(follow_symlinks=False) and P.py_lang(path):
                yield path, entry.stat().st_size

    yield from sorted(visit("", []))


def source_files(spark: SparkSession, root: str, *, default_excludes: bool = True, excludes: tuple[str, ...] = ()) -> DataFrame:
    """``file, size, content`` of a tree; content is null where it isn't UTF-8 or too large. The driver lists paths only,
    executors read. Raises ``FileNotFoundError`` where there is nothing to scan."""
    root = os.path.abspath(root)
    listed = list(walk(root, default_excludes=default_excludes, excludes=excludes))
    if not listed:
        raise FileNotFoundError(f"no supported source files under {root}")
    names = spark.createDataFrame(listed, "file string, size long").repartition(max(1, min(len(listed) // 64, 10_000)))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            contents = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with open(os.path.join(root, name), "rb") as f:
                        contents.append(f.read().decode("utf-8") if size <= K.MAX_FILE_BYTES else None)
                except (OSError, UnicodeDecodeError):
                    contents.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(contents, pa.string())], names=["file", "size", "content"])

    return names.mapInArrow(read, FILE_SCHEMA)


def stored_files(spark: SparkSession, uri: str, pattern: str = "*") -> DataFrame:
    """``file, size, content`` of all files below a URI on any file system Spark reads, without .gitignore rules: for object
    stores. Path and size are known before content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(uri)
    base = uri.rstrip("/").split("://")[-1].lstrip("/")
    file = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", ""), "^" + re.escape(base) + "/", "")
    text = F.col("content").cast("string")
    return raw.select(file.alias("file"), F.col("length").alias("size"), F.when(F.is_valid_utf8(text), text).alias("content"))
