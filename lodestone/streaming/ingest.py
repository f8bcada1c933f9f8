"""Writes that arrive as files of JSON lines, appended to a store's log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.schema import OP_LOG
from lodestone.store import DocumentStore


def ingest(store: DocumentStore, source: str, checkpoint: str, files_at_once: int = 1000, forever: bool = False) -> StreamingQuery:
    """Append the operations in ``source`` (doc_id, seq, op, source a line) to the log.

    Each micro-batch is written to a folder that its number names, replacing
    what an attempt that failed has left there: each operation is in the log
    once.  The last write of an id is the one with the greatest seq, in
    whatever order they arrive, so no watermark is needed.
    """
    stream = store.spark.readStream.schema(OP_LOG).option("maxFilesPerTrigger", files_at_once).json(source)

    def append(batch: DataFrame, number: int) -> None:
        store.append(batch, f"stream-{number:012d}")

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer if forever else writer.trigger(availableNow=True)).start()
