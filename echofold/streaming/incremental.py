"""Changes as a stream, probed against a frozen base: beyond the batch pipelines, with the same operators.

Each micro-batch of changed units is joined with the static base; findings are appended to a table. A batch that is run again
after a failure replaces its own findings, so that every finding is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..operators.check import without_same_function
from ..operators.pairs import probe_pairs


def watch_changes(changes: DataFrame, base: DataFrame, out: str, checkpoint: str, threshold: float = K.CHECK_THRESHOLD, **trigger) -> StreamingQuery:
    """Start the stream. ``changes`` (streaming) and ``base`` (static) have the columns of units; findings go to ``out`` (Parquet, a
    folder a batch): ``unit_id, original_id, similarity, file, name, original_file, original_name``."""
    theirs = base.select(F.col("unit_id").alias("original_id"), F.col("file").alias("original_file"), F.col("name").alias("original_name"))

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            found = probe_pairs(rows, base, threshold).join(rows.select("unit_id", "file", "name"), "unit_id").join(theirs, "original_id")
            without_same_function(found).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            rows.unpersist()

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
