"""Token ids of a whole corpus under a public byte-level BPE, whatever the texts' lengths.

A text up to ``chunk`` characters is encoded as it is. A longer one is cut into chunks that overlap; every chunk is
pre-tokenised on its own, in parallel, from wherever it happens to begin. Pre-tokenising is deterministic from any true
boundary on, so two neighbours agree from the first boundary that both have in their overlap: there the text is cut.
Where neighbours share none (one pre-token spans the overlap), the chunks stay together. The pieces between cuts are
encoded in parallel and their ids joined in order, which gives exactly the ids of the whole text.
"""

from __future__ import annotations

import base64
import importlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize, spread

VOCABULARY = "byte_bpe_50k.tiktoken"
_SPACES = r"\t-\r \x85\xa0  -     　"
_loaded: dict[str, tuple] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary lies: $ECHOFOLD_TOKENIZERS, else the installed package of public files."""
    folder = os.environ.get("ECHOFOLD_TOKENIZERS")
    return os.path.join(folder, name) if folder else importlib.import_module("public_tokenizers").path(name)


def _encoding(path: str):
    """(encoding, compiled pattern) of a vocabulary file; loaded once a worker."""
    if path not in _loaded:
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = public_tokenizers.PATTERN
        # white space spelled out, so that this pre-tokeniser and the encoder's agree on it
        own = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACES}").replace(r"(?!\S)", f"(?![^{_SPACES}])").replace(r"\s", f"[{_SPACES}]"))
        _loaded[path] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), own
    return _loaded[path]


def encode(text: str, path: str) -> np.ndarray:
    """Ids of a text; special tokens' names are ordinary text."""
    encoding, pattern = _encoding(path)
    try:
        return encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
    except ValueError:  # a run of white space too long for the encoder's regex: pre-tokenise here
        ids: list[int] = []
        for piece in pattern.findall(text):
            ids += encoding._encode_single_piece(piece) if len(piece) > 10_000 else encoding.encode_ordinary(piece)
        return np.array(ids, dtype=np.int32)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def _encoder(path: str, count: bool):
    """(keys..., text) -> (keys..., ids) or, with ``count``, (keys..., n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step, texts = 256, batch.column(batch.num_columns - 1)
            for i in range(0, batch.num_rows, step):
                ids = [encode(t or "", path) for t in texts.slice(i, step).to_pylist()]
                last = pa.array([len(x) for x in ids], pa.int32()) if count else _lists(ids)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, step) for c in batch.columns[:-1]), last], names=[*batch.schema.names[:-1], "n" if count else "ids"])

    return run


def _chunker(chunk: int, overlap: int):
    """(id, text) -> the chunks of each text, under a key of the row's own (ids may repeat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for r in range(batch.num_rows):
                text = batch.column(1)[r].as_py()
                starts = list(range(0, len(text), chunk))
                for i in range(0, len(starts), 128):
                    part = starts[i : i + 128]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([key] * len(part), pa.int64()), pa.array([batch.column(0)[r].as_py()] * len(part), batch.column(0).type),
                        pa.array([s // chunk for s in part], pa.int32()), pa.array([len(text)] * len(part), pa.int64()),
                        pa.array([text[s : s + chunk + overlap] for s in part], pa.string())], names=["key", "id", "idx", "size", "text"])
                key += 1

    return run


def _boundaries(path: str, chunk: int, overlap: int, margin: int = 16):
    """Adds to each chunk the boundaries (offsets in the whole text) in its head and in its tail that can be cuts.

    A cut stands after a character that isn't white space, so that no look-ahead reaches over it; the last ``margin``
    characters of a chunk aren't trusted, as a pre-token there may go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pattern = _encoding(path)
        for batch in batches:
            heads, tails = [], []
            for idx, size, text in zip(batch.column("idx").to_pylist(), batch.column("size").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start = idx * chunk
                at = np.fromiter((m.start() for m in pattern.finditer(text)), dtype=np.int64)
                heads.append((at[at < overlap] + start).astype(np.int64))
                last = start + len(text) >= size and (idx + 1) * chunk >= size
                tail = [] if last else [p + start for p in at[(at >= chunk) & (at <= len(text) - margin)] if not text[p - 1].isspace()]
                tails.append(np.array(tail, dtype=np.int64))
            big = lambda parts: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([*batch.columns, big(heads), big(tails)], names=[*batch.schema.names, "head", "tail"])

    return run


def encoded(documents: DataFrame, *, id: str = "doc_id", text: str = "text", path: str | None = None, chunk: int = 8192, overlap: int = 512, count: bool = False) -> DataFrame:
    """``id, ids`` (array<int>) of every row, or ``id, n`` with ``count``; a null and an empty text have no ids.

    Rows with the same id come out once each. Short texts take one pass without shuffle; only the texts longer than
    ``chunk`` are shuffled, by chunk. Other columns, whatever their names, are not looked at.
    """
    path = path or vocabulary_path()
    kind = documents.schema[id].dataType.simpleString()
    rows = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    out = "n int" if count else "ids array<int>"
    short = spread(rows.where(~long), "id").mapInArrow(_encoder(path, count), f"id {kind}, {out}")
    parts = (
        rows.where(long).mapInArrow(_chunker(chunk, overlap), f"key long, id {kind}, idx int, size long, text string")
        .repartition(F.xxhash64("key", "idx")).mapInArrow(_boundaries(path, chunk, overlap), f"key long, id {kind}, idx int, size long, text string, head array<long>, tail array<long>")
    )
    parts = materialize(parts, "token-chunks")
    w = Window.partitionBy("key").orderBy("idx")
    start = F.col("idx").cast("long") * chunk
    cuts = (
        parts.select("key", "idx", "size", "head", F.lag("tail").over(w).alias("before"))
        .select("key", "idx", "size", F.when(F.col("idx") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("head", "before"))).alias("cut"))
        .select("key", "idx", F.last(F.when(F.col("cut").isNotNull(), F.col("idx")), ignorenulls=True).over(w).alias("piece"),
                F.coalesce("cut", start).alias("since"), F.coalesce(F.lead("cut").over(w), F.least(start + chunk, F.col("size"))).alias("until"))
    )
    pieces = (
        parts.select("key", "id", "idx", "text").join(cuts, ["key", "idx"])
        .select("key", "id", "piece", F.struct("idx", F.expr(f"substring(text, cast(since - idx * {chunk}L as int) + 1, cast(until - since as int))").alias("text")).alias("part"))
        .groupBy("key", "id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"]), "").alias("text"))
    )
    done = pieces.mapInArrow(_encoder(path, count), f"key long, id {kind}, piece int, {out}")
    if count:
        joined = done.groupBy("key", "id").agg(F.sum("n").cast("int").alias("n")).select("id", "n")
    else:
        joined = done.groupBy("key", "id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids")).select("id", "ids")
    return short.unionByName(joined)


def _decoder(path: str):
    """(id, ids) -> (id, text): the tokens' bytes laid end to end, and only then read as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _ = _encoding(path)
        known = encoding.n_vocab
        table = pa.array([encoding.decode_single_token_bytes(i) for i in range(known)], pa.large_binary())
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = part.column(1)
                ids = np.asarray(lists.flatten())
                if len(ids) and not (0 <= ids.min() and ids.max() < known):
                    raise ValueError(f"an id is outside 0..{known - 1}")
                whole = table.take(pa.array(ids))
                ends = np.frombuffer(whole.buffers()[1], dtype=np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
                data = np.frombuffer(whole.buffers()[2], dtype=np.uint8) if len(ids) else np.zeros(0, np.uint8)
                at = ends[np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))))]
                texts = [None if null else data[a:b].tobytes().decode("utf-8", "replace") for a, b, null in zip(at, at[1:], np.asarray(lists.is_null()), strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def decoded(tokens: DataFrame, *, id: str = "id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``id, text`` of every row of token ids. No ids give an empty text, a null array a null one; bytes that are no text (ids cut inside a
    character) become replacement characters, ids that the vocabulary doesn't have are an error."""
    kind = tokens.schema[id].dataType.simpleString()
    return tokens.select(F.col(id).alias("id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(_decoder(path or vocabulary_path()), f"id {kind}, text string")
