"""Winnowed fingerprints, in Arrow batches: of token codes with a 64-bit rolling hash, of text with md5.

Both run row by row in Python over Arrow batches. The same as array expressions on the JVM took 20 times the CPU for text
(higher-order functions aren't compiled); wrapping 64-bit products raise there. Neither shuffles.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..scratch import spread

U = np.uint64


def finalise(h: np.ndarray) -> np.ndarray:
    """The splitmix64 output function on 64-bit words."""
    with np.errstate(over="ignore"):
        h = h + U(0x9E3779B97F4A7C15)
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def kgram_hashes(codes: np.ndarray, k: int = K.KGRAM) -> np.ndarray:
    """Hash of each k-gram: a polynomial over code + 1 modulo 2^64, finalised. Empty for fewer than k codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    x = codes.astype(U) + U(1)
    h = np.zeros(n, dtype=U)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * U(K.HASH_BASE) + x[j : j + n]
    return finalise(h)


def winnow_hashes(hashes: np.ndarray, w: int = K.WINDOW) -> np.ndarray:
    """Sorted distinct minima of all windows of ``w`` hashes, the rightmost on a tie; of at most w hashes their minimum."""
    if not len(hashes):
        return hashes
    if len(hashes) <= w:
        return hashes.min(keepdims=True)
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, w).min(axis=1))


def fingerprint(codes: np.ndarray, k: int = K.KGRAM, w: int = K.WINDOW) -> np.ndarray:
    return winnow_hashes(kgram_hashes(codes, k), w)


def with_fingerprints(units: DataFrame, codes: str = "codes", out: str = "fps", k: int = K.KGRAM, w: int = K.WINDOW) -> DataFrame:
    """Adds ``out`` (array<bigint>, unsigned values as signed) from an array<int> column; null codes give an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(codes))
            fps = [[] if c is None else np.sort(fingerprint(np.asarray(c, dtype=np.int64), k, w).view(np.int64)) for c in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.list_(pa.int64()))], names=[*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema) + f", `{out}` array<bigint>"
    return units.mapInArrow(run, schema)


_WORD = re.compile("[a-z0-9]+")


def text_fingerprint(text: str | None, k: int = K.KGRAM, w: int = K.WINDOW) -> tuple[int, list[str]]:
    """Number of k-grams of a text's words and the distinct minima of all windows of ``w`` of them, by md5 in hexadecimal
    (which every engine agrees on). Words are runs of ASCII letters and digits in lower case; numbers are one word, NUM,
    and a run of them counts once. Null and empty texts have none."""
    codes: list[str] = []
    for word in _WORD.findall((text or "").lower()):
        if word.isdigit():
            if codes and codes[-1] == "NUM":
                continue
            word = "NUM"
        codes.append(word)
    n = len(codes) - k + 1
    if n <= 0:
        return 0, []
    least = [hashlib.md5(" ".join(codes[i : i + k]).encode(), usedforsecurity=False).hexdigest() for i in range(n)]
    if n <= w:
        return n, [min(least)]
    # minima of spans that double, the last one as long as is left
    span = 1
    while span < w:
        step = min(span, w - span)
        least = list(map(min, least, least[step:]))
        span += step
    return n, list(dict.fromkeys(least))


def text_fingerprints(documents: DataFrame, id: str, text: str, k: int = K.KGRAM, w: int = K.WINDOW) -> DataFrame:
    """``id, kgrams, fps`` of each document, however long."""
    kind = documents.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_fingerprint(t, k, w) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([f for _, f in rows], pa.list_(pa.string()))], names=["id", "kgrams", "fps"])

    return spread(documents.select(F.col(id).alias("id"), F.col(text).alias("text")), "id").mapInArrow(run, f"id {kind}, kgrams long, fps array<string>")
