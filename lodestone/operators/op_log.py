"""The write log: upserts and deletes, snapshots, acknowledgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order(log: DataFrame) -> list[str]:
    """What orders writes: the number, and who made them where two have the same."""
    return [c for c in ("seq", "origin") if c in log.columns]


def snapshot(log: DataFrame) -> DataFrame:
    """(doc_id, source): the last body of every id whose last write isn't a delete.

    The last write is a maximum, taken before the shuffle: an id that is
    written very often costs no task more than others.
    """
    last = log.groupBy("doc_id").agg(F.max(F.struct(*_order(log), "op", "source")).alias("last"))
    return last.where("last.op = 'index'").select("doc_id", "last.source")


def settled(log: DataFrame, parts: int | None = None) -> DataFrame:
    """The log with ``present`` (whether the id was there before the write),
    ``logged`` (false for the delete of an absent id) and ``version`` (logged
    writes of the id so far).

    A row with a number in ``writes``, if the log has that column, stands for so
    many logged writes, the last of them its own.

    An id's writes are cut into ranges of ``seq`` (as many as there are shuffle
    partitions), each ordered by itself; what a range starts from, the last
    write before it and the logged writes so far, comes from one row for each
    earlier range of the id.  So an id with a large part of all writes isn't one
    task's.
    """
    parts = parts or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    width = 1 if low is None else (high - low) // parts + 1
    order = _order(log)
    writes = F.col("writes") if "writes" in log.columns else F.lit(None).cast("long")
    cut = log.withColumns({"_range": F.floor((F.col("seq") - F.lit(low or 0)) / width), "_writes": writes})
    in_range = W.partitionBy("doc_id", "_range").orderBy(*order)
    local = cut.withColumn("_before", F.lag("op").over(in_range))
    # as if the id were absent where the range starts
    one = F.coalesce("_writes", F.when((F.col("op") == "index") | (F.col("_before") == "index"), 1).otherwise(0))
    local = local.withColumn("_n", F.sum(one).over(in_range.rowsBetween(W.unboundedPreceding, 0)))
    first, last = (f(F.struct("op", "_writes"), F.struct(*order)) for f in (F.min_by, F.max_by))
    ends = cut.groupBy("doc_id", "_range").agg(first.alias("_first"), last.alias("_last"))
    counts = local.groupBy("doc_id", "_range").agg(F.max("_n").alias("_sum"))
    by_id = W.partitionBy("doc_id").orderBy("_range")
    starts = ends.join(counts, ["doc_id", "_range"]).withColumn("_there", F.coalesce(F.lag("_last.op").over(by_id) == "index", F.lit(False)))
    starts = starts.withColumn("_more", F.when(F.col("_there") & (F.col("_first.op") != "index") & F.col("_first._writes").isNull(), 1).otherwise(0))
    starts = starts.withColumn("_so_far", F.coalesce(F.sum(F.col("_sum") + F.col("_more")).over(by_id.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    joined = local.join(starts.select("doc_id", "_range", "_there", "_more", "_so_far"), ["doc_id", "_range"])
    present = F.when(F.col("_before").isNull(), F.col("_there")).otherwise(F.col("_before") == "index")
    seen = joined.withColumn("present", present)
    return seen.select(*log.columns, "present", ((F.col("op") == "index") | F.col("present")).alias("logged"), (F.col("_so_far") + F.col("_n") + F.col("_more")).cast("long").alias("version"))


def compacted(log: DataFrame) -> DataFrame:
    """(doc_id, seq, origin, op, source, writes, since): one row for each id, its last write, with its logged writes so far.

    ``log`` has ``since``, when a row last became part of what is compacted;
    the latest of them stays.  Ids whose last write is a delete stay too, as
    their versions go on counting.
    """
    last = F.max(F.struct("seq", "origin", "op", "source", "version")).alias("last")
    rows = settled(log).groupBy("doc_id").agg(last, F.max("version").alias("writes"), F.max("since").alias("since"))
    return rows.select("doc_id", "last.seq", "last.origin", "last.op", "last.source", "writes", "since")


def index_acks(log: DataFrame) -> DataFrame:
    """(doc_id, seq, version, result) of every upsert: ``created`` or ``updated``."""
    return settled(log).where("op = 'index'").select("doc_id", "seq", "version", F.when(F.col("present"), "updated").otherwise("created").alias("result"))


def delete_acks(log: DataFrame) -> DataFrame:
    """(deleted, seq) of every delete of an id that was there."""
    return settled(log).where("op = 'delete' and present").select(F.col("doc_id").alias("deleted"), "seq")


def missing_deletes(log: DataFrame) -> DataFrame:
    """(doc_id, seq) of every delete of an id that wasn't there: not found."""
    return settled(log).where("op = 'delete' and not present").select("doc_id", "seq")


def get(docs: DataFrame, doc_id: object) -> DataFrame:
    """The document with an id, or no row; the filter reaches the scan."""
    return docs.where(F.col("doc_id") == F.lit(doc_id))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id isn't among ``ids``."""
    return docs.join(ids.select("doc_id"), "doc_id", "left_anti")
