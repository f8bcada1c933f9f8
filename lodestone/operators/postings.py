"""The inverted index as tables: postings, terms and field statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.analysis import terms
from lodestone.schema import FIELDS, Field


def field_terms(docs: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """(doc_id, field, terms, dl) of every field that has a term.

    One pass over the documents: the fields are an array that is exploded, not
    a union of as many scans.
    """
    each = [F.struct(F.lit(f.name).alias("field"), terms(f.kind, F.col(f.name)).alias("terms")) for f in fields]
    return docs.select("doc_id", F.explode(F.array(*each)).alias("f")).select("doc_id", "f.field", "f.terms", F.size("f.terms").alias("dl")).where("dl > 0")


def field_lengths(docs: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    return field_terms(docs, fields).select("doc_id", "field", "dl")


def postings(docs: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """(field, term, doc_id, tf, dl), a row for each term of each field of each document.

    Terms are counted inside their document's row (sorted, then cut where they
    change), so that nothing is shuffled.
    """
    ordered = field_terms(docs, fields).select("doc_id", "field", "dl", F.array_sort("terms").alias("terms"))
    placed = ordered.select("doc_id", "field", "dl", F.array_compact(F.transform("terms", lambda t, i: F.when((i == 0) | (F.get("terms", i - 1) != t), F.struct(t.alias("term"), i.alias("at"))))).alias("heads"))
    ends = F.transform("heads", lambda h, i: F.struct(h["term"].alias("term"), (F.coalesce(F.get("heads", i + 1)["at"], F.col("dl")) - h["at"]).alias("tf")))
    return placed.select("doc_id", "field", "dl", F.explode(ends).alias("p")).select("field", "p.term", "doc_id", "p.tf", "dl")


def document_frequencies(posted: DataFrame) -> DataFrame:
    """(field, term, df): documents that have the term in that field."""
    return posted.groupBy("field", "term").agg(F.count("*").alias("df"))


def statistics(lengths: DataFrame) -> DataFrame:
    """(field, n_docs, sum_dl, avgdl) over the documents that have a term in that field."""
    sums = lengths.groupBy("field").agg(F.count("*").alias("n_docs"), F.sum(F.col("dl").cast("long")).alias("sum_dl"))
    return sums.withColumn("avgdl", F.col("sum_dl") / F.col("n_docs"))


@dataclass
class Index:
    """The tables of an index, as they were written."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    fields: tuple[Field, ...] = FIELDS


@dataclass
class Layered:
    """A written index, and the index of what has changed since it was written.

    ``changed`` has the ids whose postings in ``base`` count no more.  The
    tail's postings are those of their present documents; its document
    frequencies and statistics are differences, to be added to the base's.
    """

    base: Index
    tail: Index
    changed: DataFrame

    @property
    def fields(self) -> tuple[Field, ...]:
        return self.base.fields

    def _present(self, of: str) -> DataFrame:
        kept = getattr(self.base, of).join(self.changed, "doc_id", "left_anti")
        return kept.unionByName(getattr(self.tail, of))

    @property
    def docs(self) -> DataFrame:
        return self._present("docs")

    @property
    def postings(self) -> DataFrame:
        return self._present("postings")

    @property
    def terms(self) -> DataFrame:
        both = self.base.terms.unionByName(self.tail.terms)
        return both.groupBy("field", "term").agg(F.sum("df").alias("df"))

    @property
    def stats(self) -> DataFrame:
        both = self.base.stats.drop("avgdl").unionByName(self.tail.stats)
        sums = both.groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("sum_dl"))
        return sums.where("n_docs > 0").withColumn("avgdl", F.col("sum_dl") / F.col("n_docs"))


@dataclass
class Scan:
    """Documents without an index: each search analyses them."""

    docs: DataFrame
    fields: tuple[Field, ...] = FIELDS
