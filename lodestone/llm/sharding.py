"""Contiguous shards of near-equal byte size, cut from a global prefix sum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import id_type, map_arrow, narrowed, prefix_frame, stored

#: Bytes that a document takes in a shard besides its text.
OVERHEAD = 16


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, rows, total = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n, ends = b.num_rows, total + np.cumsum(b.column("size").to_numpy())
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(rows, rows + n)), pa.array(ends.astype(np.int64))],
            [*b.schema.names, "part", "row", "upto"],
        )
        rows, total = rows + n, int(ends[-1]) if n else total


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every document into one of ``shards`` shards, contiguous in id order.

    A document's size is the UTF-8 bytes of its text plus 16.  Ids are range
    partitioned; each partition contributes its total, the totals' prefix sums
    place each document in the whole, and document i goes to the shard that
    its middle byte falls into: every cut is within half a document of its
    target.  Texts are never moved, only (id, size, checksum).

    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each
    shard), grown_shard (null under this law).

    Null texts count as empty.  Rows that repeat an id, or have none, are
    placed by (id, checksum, size), nulls first; rows equal in all three are
    interchangeable.  A document larger than a shard's target, however long its
    text, leaves shards empty.  No documents: no rows.
    """
    spark, base = docs.sparkSession, narrowed(docs, id_col, text_col)
    text = F.coalesce("text", F.lit(""))
    sized = base.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    ranged = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(
        map_arrow(ranged, _running, [("doc_id", id_type(base)), ("size", "long"), ("text_crc32", "long"), ("part", "int"), ("row", "long"), ("upto", "long")]),
        "shards",
    )
    totals = placed.groupBy("part").agg(F.max("upto"), F.count("*")).collect()  # one row for each partition
    total = sum(t[1] for t in totals)
    before = prefix_frame(spark, [tuple(t) for t in totals], "part int, bytes_before long, rows_before long")
    ranked = placed.join(before, "part").select(
        *order,
        F.expr(f"int((2 * (bytes_before + upto) - size) * {shards} div {max(1, 2 * total)})").alias("shard"),
        (F.col("rows_before") + F.col("row")).alias("rank"),
    )
    first = ranked.groupBy("shard").agg(F.min("rank").alias("first"))  # a row for each shard
    return ranked.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
