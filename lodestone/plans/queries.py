"""A query for each operator over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.analysis import standard, standard_values
from lodestone.functions.json_values import has_object, values
from lodestone.functions.scoring import idf as idf_of
from lodestone.operators import op_log
from lodestone.operators.postings import Index, Layered, Scan, document_frequencies, field_lengths, field_terms, postings, statistics
from lodestone.operators.search import field_scores, search, top
from lodestone.schema import DEFAULT_SIZE
from lodestone.session import shared_folder
from lodestone.sources import index_files
from lodestone.sources.corpus import dynamic_fields as fields_of
from lodestone.sources.corpus import from_bodies, from_documents, from_events, json_lines
from lodestone.store import DocumentStore
from lodestone.streaming.ingest import ingest

#: The queries' strings: words of several documents, a language tag, a source tag, a repeated word.
WORDS, TAG, TWICE, NOTHING = "the tion And the", "src7", "the the and", "... !!"
LARGE = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(_table(spark, sf_dir, "documents"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(_table(spark, sf_dir, "events"))


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/lodestone/{label}-{uuid.uuid4().hex}"


#: Indexes that this application has written, by what they are of.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def _written(spark: SparkSession, sf_dir: str, label: str, docs: DataFrame) -> Index:
    """The written index of the documents; written once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _WRITTEN:
        to = _folder(spark, label)
        index_files.save(docs, to)
        _WRITTEN[key] = to
    return index_files.load(spark, _WRITTEN[key])


def _index(spark: SparkSession, sf_dir: str) -> Index:
    return _written(spark, sf_dir, "index", _docs(spark, sf_dir))


def _after_writes(spark: SparkSession, sf_dir: str) -> Layered:
    """An index of an earlier state of ``documents`` and the tail that brings it to the present one.

    In the earlier state every fifth text was another, every seventh document
    wasn't there yet, and there were others, which have been deleted since.
    """
    docs = _table(spark, sf_dir, "documents")
    gone = docs.where("doc_id % 3 = 0").withColumn("doc_id", -1 - F.col("doc_id"))
    stale = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("And the tion once\n"), "text")).otherwise(F.col("text")))
    base = _written(spark, sf_dir, "stale-index", from_documents(stale.unionByName(gone)))
    written = docs.where("doc_id % 7 = 0 or doc_id % 5 = 0")
    key = (spark.sparkContext.applicationId, sf_dir, "tail")
    if key not in _WRITTEN:
        to = _folder(spark, "tail")
        index_files.save_tail(base, written.select("doc_id").unionByName(gone.select("doc_id")), from_documents(written), to)
        _WRITTEN[key] = to
    return index_files.load_tail(base, _WRITTEN[key])


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with nested arrays and objects, made from ``documents``."""
    source = F.expr("""
        concat('{"title": "', source, '", "tags": [["', lang, '", ["', source, '", [', n_chars, ', null]]], true, ', n_chars, '.5], "meta": {"n": ', n_chars,
            ', "day": "2024-01-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), '", "deep": {"list": [1, "x", [2.0, "2024-01-02T03:04:05Z"], {"ok": false}], "none": null}}}')
    """)
    return _table(spark, sf_dir, "documents").select("doc_id", source.alias("source"))


def _joined(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *[F.array_join(c, " ").alias(c) for c in ("title", "content", "tags")])


def get_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(op_log.get(_docs(spark, sf_dir), 42))


def get_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(op_log.get(_docs(spark, sf_dir), -1))


def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op_log.snapshot(_log(spark, sf_dir))


def upsert_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op_log.index_acks(_log(spark, sf_dir))


def delete_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = _table(spark, sf_dir, "labels").where("toxic = 1")
    return _joined(op_log.without(_docs(spark, sf_dir), toxic)).select("doc_id", "title", "tags")


def delete_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op_log.delete_acks(_log(spark, sf_dir))


def delete_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op_log.missing_deletes(_log(spark, sf_dir))


def json_body_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = values(F.col("source"), "k")
    return _log(spark, sf_dir).select("doc_id", "seq", F.array_join(k, " ").alias("k"), F.size(k).cast("long").alias("n_values"))


def dynamic_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields_of(_log(spark, sf_dir))


def json_body_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = from_bodies(_bodies(spark, sf_dir))
    return docs.select(
        "doc_id",
        F.array_join("title", " ").alias("title"),
        F.array_join("tags", " ").alias("tags"),
        F.size("tags").cast("long").alias("n_tags"),
        F.size("content").cast("long").alias("n_content"),
        has_object(F.col("source"), "meta").alias("meta_is_rejected"),
        has_object(F.col("source"), "tags").alias("tags_are_rejected"),
    )


def dynamic_fields_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields_of(_bodies(spark, sf_dir))


def json_lines_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "lines")
    _table(spark, sf_dir, "documents").selectExpr("""concat('{"id": "d', doc_id, '", "tags": ["', lang, '", "', source, '"]}') AS value""").write.text(path)
    read = from_bodies(json_lines(spark, path))
    return read.select("doc_id", F.array_join("tags", " ").alias("tags"))


def ingest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log arrives as files of JSON lines; the store has what is left of it."""
    at = _folder(spark, "ingest")
    _log(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "seq", "op", "source").write.json(f"{at}/inbox")
    store = DocumentStore(spark, f"{at}/store")
    ingest(store, f"{at}/inbox", f"{at}/progress").awaitTermination()
    return op_log.snapshot(store.log())


def compacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the log compacted, then that with the rest: last writes and versions as of the whole."""
    log = _log(spark, sf_dir).withColumns({"origin": F.lit("log"), "writes": F.lit(None).cast("long"), "since": F.lit(0).cast("long")})
    half = log.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0] or 0
    rows = op_log.compacted(op_log.compacted(log.where(F.col("seq") <= half)).unionByName(log.where(F.col("seq") > half)))
    return rows.select("doc_id", "seq", "op", "source", F.col("writes").alias("version"))


def tokenize_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(standard(F.col("text")), " ").alias("terms"))


def tokenize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.array_join(standard(F.col("html")), " ").alias("terms"))


def multivalue_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a text is a value of its field."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("values"))
    told = lines.select("doc_id", F.size("values").cast("long").alias("n_values"), standard_values(F.col("values")).alias("terms"))
    return told.select("doc_id", "n_values", F.array_join("terms", " ").alias("terms"), F.size("terms").cast("long").alias("dl")).where("dl > 0")


def keyword_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = field_terms(_docs(spark, sf_dir)).where("field = 'tags'")
    return tagged.select("doc_id", F.array_join("terms", " ").alias("terms"), F.col("dl").cast("long").alias("dl"))


def field_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_lengths(_docs(spark, sf_dir)).select("doc_id", "field", F.col("dl").cast("long").alias("dl"))


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(_docs(spark, sf_dir)).select("field", "term", "doc_id", F.col("tf").cast("long").alias("tf"))


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_frequencies(postings(_docs(spark, sf_dir)))


def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(field_lengths(_docs(spark, sf_dir))).withColumn("avgdl", F.round("avgdl", 6))


def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    stats = F.broadcast(statistics(field_lengths(docs)))  # a row for each field
    return document_frequencies(postings(docs)).join(stats, "field").select("field", "term", "df", F.round(idf_of(F.col("n_docs"), F.col("df")), 6).alias("idf"))


def _scores(spark: SparkSession, sf_dir: str, q: str, *columns: str) -> DataFrame:
    scored = field_scores(Scan(_docs(spark, sf_dir)), q)
    for c in columns:
        scored = scored.where(F.col(c).isNotNull())
    return scored.select("doc_id", *columns)


def bm25_single_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, WORDS, "content_score")


def boosted_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, WORDS, "title_score")


def keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, TAG, "tags_score")


def match_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_scores(Scan(_docs(spark, sf_dir)), WORDS).select("doc_id")


def duplicate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, TWICE, "_score")


def zero_term_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, NOTHING, "_score")


def best_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_scores(Scan(_docs(spark, sf_dir)), WORDS)


def _ranked(found: DataFrame) -> DataFrame:
    """The rank of each of at most 10,000 results."""
    return found.withColumn("rank", F.row_number().over(W.orderBy(F.desc("_score"), "doc_id")).cast("long"))


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(Scan(_docs(spark, sf_dir)))


def search_size_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(top(Scan(_docs(spark, sf_dir)), WORDS, LARGE)).select("rank", "doc_id", "_score")


def _topk(source: Scan | Index | Layered) -> DataFrame:
    return _ranked(search(source, WORDS, DEFAULT_SIZE)).select("rank", "doc_id", "_score", *[F.array_join(c, " ").alias(c) for c in ("title", "content", "tags")])


def search_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(_index(spark, sf_dir))


def search_index_size_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(top(_index(spark, sf_dir), WORDS, LARGE)).select("rank", "doc_id", "_score")


def best_fields_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_scores(_index(spark, sf_dir), WORDS)


def duplicate_terms_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_scores(_index(spark, sf_dir), TWICE).select("doc_id", "_score")


def search_after_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(_after_writes(spark, sf_dir))


def best_fields_after_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_scores(_after_writes(spark, sf_dir), WORDS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        get_document, get_missing, upsert_snapshot, upsert_ack, delete_snapshot, delete_ack, delete_missing, json_body_fields, dynamic_fields,
        json_body_nested, dynamic_fields_nested, json_lines_read, ingest_snapshot, compacted_log,
        tokenize_standard, tokenize_pages, multivalue_flatten, keyword_terms, field_length, term_frequency, document_frequency,
        collection_stats, idf, bm25_single_field, boosted_title, keyword_match, match_or, duplicate_terms, zero_term_query,
        best_fields, search_topk, search_size_k, search_index_topk, search_index_size_k, best_fields_index, duplicate_terms_index,
        search_after_writes, best_fields_after_writes,
    )
    return {f.__name__: f for f in each}
