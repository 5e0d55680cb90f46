"""Files to units: the functions of every file with their fingerprints, and the shapes of C# types."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import content as C
from ..functions import paths as P
from ..operators.fingerprints import fingerprint
from ..scratch import spread
from .lexer import Token, normalise, tokenize
from .scanners import SCANNERS, header, matches, scan

UNIT = ("struct<name:string,start_line:int,end_line:int,start_byte:int,end_byte:int,sig_lines:int,fps:array<bigint>,is_test:boolean,is_trait_impl_method:boolean>")
_TEST_MOD = re.compile(r"#\[cfg\(test\)\]\s*(?:pub )?mod[ \t][^{;]*\{")


def _bytes(text: str, at: int) -> int:
    return at if text.isascii() else len(text[:at].encode())


def analyse(lang: str, text: str, min_tokens: int = K.MIN_TOKENS, is_test: bool = False) -> tuple[list[dict], int, int]:
    """Units, significant lines and lines of a source text.

    Only bodies are compared; those with fewer than ``min_tokens`` codes or without fingerprints are no units. In Rust
    everything from an inline test module on is test code. Text that can't be read gives what could be.
    """
    if lang not in SCANNERS:
        return [], 0, text.count("\n") + (not text.endswith("\n") and text != "")
    tokens, found = scan(lang, text)
    mod = _TEST_MOD.search(text) if lang == "rust" and not is_test else None
    units = []
    for f in found:
        codes, lines = normalise(tokens[f.body : f.last], f.operators)
        if len(codes) < min_tokens:
            continue
        fps = fingerprint(np.array(codes, dtype=np.int64))
        if not len(fps):
            continue
        start, end = tokens[f.first].start, tokens[f.last - 1].end
        units.append({
            "name": f.name, "start_line": tokens[f.first].row + 1, "end_line": tokens[f.last - 1].row + text.count("\n", tokens[f.last - 1].start, end) + 1,
            "start_byte": _bytes(text, start), "end_byte": _bytes(text, end), "sig_lines": lines, "fps": np.sort(fps.view(np.int64)).tolist(),
            "is_test": bool(is_test or (mod and start >= mod.start())), "is_trait_impl_method": f.required_name})
    total = text.count("\n") + (not text.endswith("\n") and text != "")
    return units, len({t.row for t in tokens}), total


# ---- class shapes ------------------------------------------------------------------------------------------------------

_TYPE = re.compile(r"(?:^|\s)(?:class|struct|record(?: (?:class|struct))?) (?P<name>\w+)(?: <[^{]*>)?(?P<ctor> \(\))?(?: : .+)?(?: where .+)?$")
_NESTED = re.compile(r"\b(?:class|struct|record|interface|enum|delegate|namespace)\s+\w")


def _signature_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _squeeze(text: str) -> str:
    return " ".join(text.split())


def _parameter_types(tokens: list[Token], pair: dict[int, int], text: str, at: int) -> str:
    """``ctor(T1, T2)`` of the parameter list that opens at token ``at``."""
    types, begin, i, last = [], at + 1, at + 1, pair[at]
    while i <= last:
        if i == last or tokens[i].text == ",":
            part = [t for t in tokens[begin:i]]
            cut = next((k for k, t in enumerate(part) if t.text == "="), len(part))
            part = part[:cut]
            if len(part) > 1:
                types.append(_squeeze(text[part[0].start : part[-2].end]))
            begin = i + 1
        elif tokens[i].text in ("(", "[", "{") and i in pair:
            i = pair[i]
        elif tokens[i].text == "<":
            depth = 1
            while depth and i + 1 < last:
                i += 1
                depth += {"<": 1, ">": -1}.get(tokens[i].text, 0)
        i += 1
    return f"ctor({', '.join(types)})"


def class_shapes(text: str, is_test: bool = False) -> list[dict]:
    """C# types with at least three distinct member signatures, as units whose fingerprints are those signatures.

    A member's signature is its text up to its body; constructors, classic or on the header, count by their parameter
    types. ``sig_lines`` is the number of signatures.
    """
    tokens = tokenize("csharp", text)
    pair, units = matches(tokens), []
    for i, t in enumerate(tokens):
        if t.text != "{" or i not in pair:
            continue
        head, first = header(tokens, pair, i)
        m = _TYPE.search(head)
        if not m:
            continue
        signatures, j = set(), i + 1
        if m.group("ctor"):
            at = next(k for k in range(first, i) if tokens[k].text == "(")
            signatures.add(_parameter_types(tokens, pair, text, at))
        while j < pair[i]:
            begin = j
            while j < pair[i] and tokens[j].text not in (";", "{", "=>"):
                j = pair[j] + 1 if tokens[j].text in ("(", "[") and j in pair else j + 1
            words = _squeeze(text[tokens[begin].start : tokens[j].start].strip().rstrip(";{").rstrip()) if j < len(tokens) else ""
            opened = next((k for k in range(begin, j) if tokens[k].text == "("), None)
            if words and not _NESTED.search(words):
                ctor = opened is not None and opened > begin and tokens[opened - 1].text == m.group("name") and "=" not in words.split("(")[0]
                signatures.add(_parameter_types(tokens, pair, text, opened) if ctor and opened in pair else words)
            if j < pair[i] and tokens[j].text == "{":
                j = pair.get(j, j) + 1
                if j < pair[i] and tokens[j].text == "=":
                    while j < pair[i] and tokens[j].text != ";":
                        j = pair[j] + 1 if tokens[j].text in ("(", "[", "{") and j in pair else j + 1
                    j += 1
            elif j < pair[i] and tokens[j].text == "=>":
                while j < pair[i] and tokens[j].text != ";":
                    j = pair[j] + 1 if tokens[j].text in ("(", "[", "{") and j in pair else j + 1
                j += 1
            else:
                j += 1
        if len(signatures) >= K.SHAPE_MIN_MEMBERS:
            units.append({"name": m.group("name"), "start_line": tokens[first].row + 1, "end_line": tokens[pair[i]].row + 1, "start_byte": _bytes(text, tokens[first].start), "end_byte": _bytes(text, tokens[pair[i]].end),
                          "sig_lines": len(signatures), "fps": sorted(map(_signature_hash, signatures)), "is_test": is_test, "is_trait_impl_method": False})
    return units


# ---- DataFrames ----------------------------------------------------------------------------------------------------------


def analysed(sources: DataFrame, *, min_tokens: int = K.MIN_TOKENS, shapes: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, lang, sig_lines, total_lines, units`` (and ``shapes``) of ``sources(key, lang, is_test, content)``, file by file in parallel,
    with the columns of ``keep`` as they are.

    A source with a null language or content has no units and null line counts.
    """
    kind = sources.schema["key"].dataType.simpleString()
    kept = "".join(f", {c} {sources.schema[c].dataType.simpleString()}" for c in keep)
    fields = [pa.field("name", pa.string()), pa.field("start_line", pa.int32()), pa.field("end_line", pa.int32()), pa.field("start_byte", pa.int32()), pa.field("end_byte", pa.int32()),
              pa.field("sig_lines", pa.int32()), pa.field("fps", pa.list_(pa.int64())), pa.field("is_test", pa.bool_()), pa.field("is_trait_impl_method", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [([], None, None) if lang is None or text is None else analyse(lang, text, min_tokens, bool(test))
                        for lang, test, text in zip(part.column("lang").to_pylist(), part.column("is_test").to_pylist(), part.column("content").to_pylist(), strict=True)]
                found = [class_shapes(text, bool(test)) if shapes and lang == "csharp" and text else [] for lang, test, text in zip(part.column("lang").to_pylist(), part.column("is_test").to_pylist(), part.column("content").to_pylist(), strict=True)]
                unit = pa.list_(pa.struct(fields))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("lang"), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[0] for r in rows], unit), pa.array(found, unit), *(part.column(c) for c in keep)],
                                                 names=["key", "lang", "sig_lines", "total_lines", "units", "shapes", *keep])

    return spread(sources.select("key", "lang", "is_test", "content", *keep), "key").mapInArrow(run, f"key {kind}, lang string, sig_lines int, total_lines int, units array<{UNIT}>, shapes array<{UNIT}>{kept}")


def exploded_units(analysis: DataFrame, column: str = "units", *extra: str) -> DataFrame:
    """One row a unit: ``unit_id, file_id, file, lang`` and the unit's fields. The id hashes file and span, so that it is
    the same on every run; ``key`` must name the file."""
    u = analysis.select("key", "lang", *extra, F.explode(column).alias("u"))
    return u.select(F.xxhash64("key", *extra, "u.start_byte", "u.end_byte", "u.name").alias("unit_id"), F.xxhash64("key", *extra).alias("file_id"), F.col("key").alias("file"), "lang", *extra, "u.*")


def scannable(files: DataFrame, *, default_excludes: bool = True, skip_tests: bool = False) -> DataFrame:
    """Adds ``lang, is_test`` to ``files(file, size, content)`` and keeps those to be scanned: a known language, not excluded, not too
    large. All three predicates are on path and size and reach the scan; content isn't read for files they drop."""
    out = files.withColumn("lang", P.lang_of(F.col("file"))).withColumn("is_test", P.is_test_path(F.col("file"))).where(F.col("lang").isNotNull() & (F.coalesce("size", F.lit(0)) <= K.MAX_FILE_BYTES))
    if default_excludes:
        out = out.where(~P.default_excluded(F.col("file")))
    return out.where("not is_test") if skip_tests else out


def with_skip_reason(files: DataFrame) -> DataFrame:
    return files.withColumn("skip", C.skip_reason(F.col("content")))
