"""An index as Parquet, laid out for look-ups by term."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.postings import Index, Layered, document_frequencies, field_lengths, postings, statistics
from lodestone.schema import FIELDS, LARGEST_SIZE, Field

#: Values of a filter that Parquet's row groups are tested for one by one; with more, only their range is.
FILTER_VALUES = "spark.sql.parquet.pushdown.inFilterThreshold"


def save(docs: DataFrame, path: str, fields: tuple[Field, ...] = FIELDS, files: int | None = None) -> Index:
    """Write an index: postings in a folder for each field, ranges of terms in each file, sorted.

    A term's postings are then in few files and row groups, which a search finds
    by their least and greatest terms.  A frequent term is spread over several
    ranges, by document.  Documents are sorted by id, with Bloom filters on it.
    Texts are analysed once: postings are written as they come and then put in
    order, as ranges are cut by a sample; terms and statistics are computed from
    what was written.
    """
    spark = docs.sparkSession
    _write_docs(docs, path, files)
    unsorted = f"{path}/unsorted"
    postings(spark.read.parquet(f"{path}/docs"), fields).write.mode("overwrite").option("compression", "zstd").parquet(unsorted)
    order = ["field", "term", "doc_id"]
    posted = spark.read.parquet(unsorted)
    ranged = posted.repartitionByRange(files, *order) if files else posted.repartitionByRange(*order)
    _write_by_field(ranged.sortWithinPartitions(*order), f"{path}/postings")
    _delete(spark, unsorted)
    again = spark.read.schema(_schemas(docs)["postings"]).parquet(f"{path}/postings")
    _write_by_field(document_frequencies(again).sortWithinPartitions("field", "term"), f"{path}/terms")
    statistics(again.groupBy("field", "doc_id").agg(F.first("dl").alias("dl"))).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return load(spark, path, fields)


def load(spark: SparkSession, path: str, fields: tuple[Field, ...] = FIELDS) -> Index:
    spark.conf.set(FILTER_VALUES, str(LARGEST_SIZE))
    docs = spark.read.parquet(f"{path}/docs")
    schemas = _schemas(docs)
    return Index(docs, *(spark.read.schema(schemas[t]).parquet(f"{path}/{t}") for t in ("postings", "terms", "stats")), fields)


def save_tail(base: Index, changed: DataFrame, present: DataFrame, path: str) -> None:
    """Write what has changed since ``base``: ids (doc_id), and their documents that are there now.

    The ids' documents in the base are analysed again, so that what they were
    counted with can be taken off its frequencies and statistics.
    """
    spark, fields = present.sparkSession, base.fields
    changed.select("doc_id").distinct().write.mode("overwrite").parquet(f"{path}/changed")
    _write_docs(present, path)
    docs = spark.read.schema(base.docs.schema).parquet(f"{path}/docs")
    before = with_ids(base.docs, spark.read.schema(changed.select("doc_id").schema).parquet(f"{path}/changed"))
    signed = [(docs, 1), (before, -1)]
    _write_by_field(postings(docs, fields).sortWithinPartitions("field", "term", "doc_id"), f"{path}/postings")
    terms = [document_frequencies(postings(d, fields)).withColumn("df", F.col("df") * n) for d, n in signed]
    sums = terms[0].unionByName(terms[1]).groupBy("field", "term").agg(F.sum("df").alias("df")).where("df <> 0")
    _write_by_field(sums.sortWithinPartitions("field", "term"), f"{path}/terms")
    lengths = [field_lengths(d, fields).select("field", (F.col("dl").cast("long") * n).alias("dl"), F.lit(n).cast("long").alias("n")) for d, n in signed]
    stats = lengths[0].unionByName(lengths[1]).groupBy("field").agg(F.sum("n").alias("n_docs"), F.sum("dl").alias("sum_dl"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def load_tail(base: Index, path: str) -> Layered:
    spark, schemas = base.docs.sparkSession, _schemas(base.docs)
    read = {t: spark.read.schema(schemas[t]).parquet(f"{path}/{t}") for t in ("postings", "terms", "stats")}
    docs, changed = spark.read.schema(base.docs.schema).parquet(f"{path}/docs"), spark.read.schema(base.docs.select("doc_id").schema).parquet(f"{path}/changed")
    return Layered(base, Index(docs, read["postings"], read["terms"], read["stats"].drop("avgdl"), base.fields), changed)


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with one of the ids; few ids become a filter that reaches the scan."""
    few = ids.select("doc_id").limit(LARGEST_SIZE + 1).collect()
    if len(few) <= LARGEST_SIZE:
        docs.sparkSession.conf.set(FILTER_VALUES, str(LARGEST_SIZE))
        return docs.where(F.col("doc_id").isin([r[0] for r in few]))
    return docs.join(ids, "doc_id", "left_semi")


def _schemas(docs: DataFrame) -> dict[str, str]:
    """The tables' columns: an index without postings has no file that tells them."""
    of = docs.schema["doc_id"].dataType.simpleString()
    return {
        "postings": f"term string, doc_id {of}, tf int, dl int, field string",
        "terms": "term string, df long, field string",
        "stats": "field string, n_docs long, sum_dl long, avgdl double",
    }


def _write_docs(docs: DataFrame, path: str, files: int | None = None) -> None:
    by_id = docs.repartitionByRange(files, "doc_id") if files else docs.repartitionByRange("doc_id")
    by_id.sortWithinPartitions("doc_id").write.mode("overwrite").option("compression", "zstd").option("parquet.bloom.filter.enabled#doc_id", "true").parquet(f"{path}/docs")


def _write_by_field(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("field").option("compression", "zstd").parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
