"""Ranked search: terms of the query, BM25 by field, the best field's score, the top k."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import InvalidQuery, InvalidSize
from lodestone.functions.analysis import standard
from lodestone.functions.scoring import coded_length, saturation, weight
from lodestone.operators.postings import Index, Layered, Scan, field_terms
from lodestone.schema import DEFAULT_SIZE, LARGEST_SIZE, Field

#: Decimals of a score; sums in another order differ behind these.
DECIMALS = 6
#: Distinct words of a query at most.
MOST_WORDS = 1024

Source = Index | Layered | Scan


def query_terms(spark: SparkSession, q: str, fields: tuple[Field, ...]) -> list[tuple[str, float, str, int]]:
    """(field, boost, term, times) of a query; a keyword field has the whole query as its one term."""
    words = Counter(spark.range(1).select(standard(F.lit(q)).alias("w")).first()["w"])
    if len(words) > MOST_WORDS:
        raise InvalidQuery(f"the query has {len(words)} distinct words, more than {MOST_WORDS}")
    return [(f.name, f.boost, t, n) for f in fields for t, n in ({q: 1} if f.kind == "keyword" else words).items()]


def matches(source: Source, q: str) -> DataFrame:
    """(doc_id, field, tf, dl, avgdl, weight): the postings of the query's terms."""
    wanted = query_terms(source.docs.sparkSession, q, source.fields)
    return _counted(source, wanted) if isinstance(source, Scan) else _looked_up(source, wanted)


def _looked_up(index: Index | Layered, wanted: list[tuple]) -> DataFrame:
    """From an index: the terms are a filter on the postings that reaches the
    scan (a partition for each field, row groups by term), and a broadcast of a
    row for each term asked."""
    names = sorted({w[2] for w in wanted})
    asked = index.docs.sparkSession.createDataFrame(wanted, "field string, boost double, term string, qtf long")
    known = index.terms.where(F.col("term").isin(names))
    weights = known.join(F.broadcast(asked), ["field", "term"]).join(F.broadcast(index.stats), "field")  # a row for each field
    weights = weights.select("field", "term", "avgdl", weight(F.col("boost"), F.col("qtf"), F.col("n_docs"), F.col("df")).alias("weight"))
    return index.postings.where(F.col("term").isin(names)).join(F.broadcast(weights), ["field", "term"])


def _counted(scan: Scan, wanted: list[tuple]) -> DataFrame:
    """From texts: the asked terms are counted in each document's terms, which
    are never exploded; one grouping by field gives all frequencies.

    The counts of a document are a few numbers.  They are dealt by document
    once, and both the statistics and the matches read that one exchange, so
    that texts are analysed once: for that, the two must need the same columns
    and rows of it, which is why statistics have ``_last`` and matches are
    filtered by it.
    """
    asked = {f.name: [(boost, t, n) for name, boost, t, n in wanted if name == f.name] for f in scan.fields}
    most = max(map(len, asked.values()), default=0)

    def times(term: str) -> F.Column:
        return F.size(F.filter("terms", lambda x: x == F.lit(term)))

    def chosen(pick: Callable[[tuple], F.Column], i: int) -> F.Column:
        out = F.lit(None)
        for name, own in asked.items():
            if i < len(own):
                out = F.when(F.col("field") == name, pick(own[i])).otherwise(out)
        return out

    counts = [F.coalesce(chosen(lambda a: times(a[1]), i), F.lit(0)).alias(f"tf{i}") for i in range(most)]
    counted = field_terms(scan.docs, scan.fields).select("doc_id", "field", "dl", *counts).repartition("doc_id")
    frequencies = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(most)]
    stats = counted.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), F.max("doc_id").alias("_last"), *frequencies)
    held = F.greatest(F.lit(0), F.lit(0), *[F.col(f"tf{i}") for i in range(most)])
    found = counted.join(F.broadcast(stats), "field").where(F.when(F.col("doc_id") <= F.col("_last"), held) > 0)  # a row for each field
    each = [F.struct(F.col(f"tf{i}").alias("tf"), weight(chosen(lambda a: F.lit(a[0]), i), chosen(lambda a: F.lit(a[2]), i), F.col("n_docs"), F.col(f"df{i}")).alias("weight")) for i in range(most)]
    if not each:
        each = [F.struct(F.lit(0).alias("tf"), F.lit(None).cast("double").alias("weight"))]
    return found.select("doc_id", "field", "dl", "avgdl", F.explode(F.array(*each)).alias("m")).where("m.tf > 0").select("doc_id", "field", "m.tf", "dl", "avgdl", "m.weight")


def field_scores(source: Source, q: str, coded: bool = False) -> DataFrame:
    """(doc_id, <field>_score ..., _score): every document that has a term in a field.

    With ``coded`` lengths are rounded as an index that keeps a byte for each does.

    One shuffle: each field's sum is a conditional sum of the same grouping, and
    the score is the greatest of them.
    """
    flat = {f.name for f in source.fields if f.kind == "keyword"}
    length = coded_length(F.col("dl")) if coded else F.col("dl")
    dl = F.when(F.col("field").isin(*flat), 1).otherwise(length) if flat else length
    scored = matches(source, q).select("doc_id", "field", (F.col("weight") * saturation(F.col("tf"), dl, F.col("avgdl"))).alias("s"))
    sums = scored.groupBy("doc_id").agg(*[F.round(F.sum(F.when(F.col("field") == f.name, F.col("s"))), DECIMALS).alias(f"{f.name}_score") for f in source.fields])
    each = [F.col(f"{f.name}_score") for f in source.fields]
    return sums.withColumn("_score", F.greatest(*each) if len(each) > 1 else each[0])


def top(source: Source, q: str, size: int = DEFAULT_SIZE) -> DataFrame:
    """(doc_id, _score): the ``size`` best, ties in id order."""
    if not 0 <= size <= LARGEST_SIZE:
        raise InvalidSize(f"size {size} is not in 0..{LARGEST_SIZE}")
    return field_scores(source, q).select("doc_id", "_score").orderBy(F.desc("_score"), "doc_id").limit(size)


def search(source: Source, q: str, size: int = DEFAULT_SIZE) -> DataFrame:
    """The best documents' columns and ``_score``, which wins over a column of that name.

    Scores are computed without reading the bodies.  From an index, the
    ``size`` ids, 10,000 at most, then go to the driver and back as a filter
    that reaches the scan of the bodies, which are sorted by id.
    """
    best, docs = top(source, q, size).withColumnRenamed("_score", "_best"), source.docs.drop("_score")
    if not isinstance(source, Scan):
        rows = best.collect()
        best = source.docs.sparkSession.createDataFrame(rows, best.schema)
        docs = docs.where(F.col("doc_id").isin([r["doc_id"] for r in rows]))
    found = docs.join(F.broadcast(best), "doc_id")
    return found.withColumnRenamed("_best", "_score").orderBy(F.desc("_score"), "doc_id")
