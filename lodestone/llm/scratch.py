"""Shared scratch space and small helpers that every operator here uses."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import shared_folder

#: Rows in one Arrow batch that goes to a Python worker.  Texts can be long, so
#: that a batch of the default 10,000 rows would not be bounded well.
BATCH_ROWS = 512


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/lodestone/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here."""
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing that is still to run reads it."""
    for df in frames:
        if path := df.__dict__.pop("_stored_at", None):
            delete(df.sparkSession, path)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def narrowed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` and ``text`` alone: no other column can clash or be carried."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def id_type(df: DataFrame) -> T.DataType:
    return df.schema["doc_id"].dataType


def shipped(spark: SparkSession) -> None:
    """Hand this package to the executors, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestone_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="lodestone-code-")) / "lodestone.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(to))
    sc._lodestone_shipped = True


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: list[tuple[str, str | T.DataType]]) -> DataFrame:
    """``mapInArrow`` with a schema given as (name, type) pairs."""
    small_batches(df.sparkSession)
    shipped(df.sparkSession)
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t) if isinstance(t, str) else t) for n, t in fields])
    return df.mapInArrow(fn, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts' UTF-8 bytes, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def prefix_frame(spark: SparkSession, totals: list[tuple], names: str) -> DataFrame:
    """(partition, total, ...) rows to a table (partition, sum before, ...).

    There is one row for each partition, so that the table is bounded by the
    number of tasks, not by the data.
    """
    out, sums = [], None
    for part, *values in sorted(totals):
        sums = sums or [0] * len(values)
        out.append((part, *sums))
        sums = [a + b for a, b in zip(sums, values, strict=True)]
    return F.broadcast(spark.createDataFrame(out, names))
