"""Token counts through a cache of counts keyed by content and tokenizer version."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import encoder
from lodestone.llm.scratch import delete, map_arrow, narrowed, scratch_path, stored

CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """A digest of the tokenizer's file and of the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    h = hashlib.sha256(Path(path).read_bytes())
    h.update(f"{library} {version(library)}".encode())
    return h.hexdigest()


def _cached(spark: SparkSession, cache_path: str, of: str) -> DataFrame:
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except Exception as e:  # the first run has no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    # a run that was cut short and repeated may have appended a digest twice
    return cache.where(F.col("version") == of).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens in every text, encoding only contents that the cache hasn't.

    Content is normalised as the tokenizer itself does (nothing for byte-level
    BPE), null to the empty text; its SHA-256 and the tokenizer's version are
    the cache's key.  Contents that the cache lacks are made distinct, encoded
    once and appended to the cache; then every document is joined to its count.

    ``cache_path``: a Parquet folder that outlives the run; if None, the one that
    the session's ``lodestone.token_cache`` names, else a new one in the shared
    folder, which is deleted at the end.  Returns doc_id, n_bytes, n_tokens, over_limit
    (more than ``limit`` tokens).

    Each input row gives one row, repeated ids and texts included; no rows, no
    rows.  A text of any length is encoded as a whole.  Copies are reduced before they are shuffled, so that a group of
    copies of any size is one content.
    """
    spark, base = docs.sparkSession, narrowed(docs, id_col, text_col)
    of, named = tokenizer_version(tokenizer_path), cache_path or spark.conf.get("lodestone.token_cache", None)
    cache_path = named or scratch_path(spark, "token-cache")
    keyed = base.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digest", F.unhex(F.sha2("text", 256)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in batches:
            counts = [len(i) // 4 for i in enc.ids(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([of] * b.num_rows, pa.string()), b.column("digest"), pa.array(counts, pa.int64())], ["version", "digest", "n_tokens"])

    # distinct before the join: copies are combined in the tasks that read them
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(_cached(spark, cache_path, of), "digest", "left_anti").select("digest", "text")
    map_arrow(misses, encode, [("version", "string"), ("digest", "binary"), ("n_tokens", "long")]).write.mode("append").parquet(cache_path)

    # written, so that nothing but the join stands on the shuffle below, and a content of very many documents can be split there
    counts = stored(_cached(spark, cache_path, of).join(keyed.select("digest").distinct(), "digest", "left_semi"), "counts")
    if not named:
        delete(spark, cache_path)
    sized = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sized.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
