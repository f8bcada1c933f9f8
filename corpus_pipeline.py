"""The corpus pipeline: filter, deduplicate, decontaminate and pack ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next stage's documents.  All stages
but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.decontamination import decontaminated
from lodestone.llm.entries import QUALITY_THRESHOLD, TOKENIZER, id_remainder, table
from lodestone.llm.packing import pack_documents
from lodestone.llm.quality import score_rows, train
from lodestone.llm.scratch import discard, stored
from lodestone.llm.similar_sets import similar_classes
from lodestone.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (label 1 with 0.3 or more).

    Null and empty texts have a score as any other.  Without labels of both
    kinds nothing can be learned, every score is 0.5 and all rows stay.
    """
    vectors, model = train(docs, table(spark, sf_dir, "labels").where(id_remainder(5) != 0))
    return score_rows(docs, vectors, model).where(F.col("score") >= QUALITY_THRESHOLD).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies (five-word shingles, Jaccard similarity 0.8 or more).

    Fingerprints' tries find the pairs, whole shingle sets decide.  The row that
    stays is the one with the smallest id, null ids last.  Rows have numbers of
    their own here, so that rows that repeat an id, or have none, are told
    apart.  Null, empty and white texts are copies of each other.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("number"), row), "numbered")
    classes = similar_classes(numbered.select("number", F.col("row.text").alias("text")), words_in_shingle=5)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "number")).alias("least")
    kept = classes.join(numbered.select("number", "row.doc_id"), "number").groupBy("class").agg(least).select("least.number")
    return numbered.join(kept, "number").select("row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that repeat; a character that is cut goes as a whole.

    Every row stays, if with an empty text; a null text stays null.
    """
    cut = remove_repeats(docs, as_text=True)
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.length("kept")).cast("long")}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item; null and empty texts hold none."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences of 1024 tokens; an empty or null text is its end id alone."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), capacity=1024, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
