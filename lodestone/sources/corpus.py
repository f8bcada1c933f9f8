"""Documents from tables and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.json_values import body, depth, has_object, is_object, members, values
from lodestone.schema import FIELDS


def from_bodies(bodies: DataFrame) -> DataFrame:
    """(doc_id, source) to documents: the declared fields' values out of the JSON bodies."""
    return bodies.select("doc_id", *[values(F.col("source"), f.name).alias(f.name) for f in FIELDS], "source")


def rejected(bodies: DataFrame) -> DataFrame:
    """Bodies that can't be indexed: no JSON objects, or an object in a declared field."""
    bad = ~is_object(F.col("source"))
    for f in FIELDS:
        bad = bad | has_object(F.col("source"), f.name)
    return bodies.where(bad)


def dynamic_fields(bodies: DataFrame) -> DataFrame:
    """(field, type, n): the fields that bodies have, with the types that their values show.

    An object's members are fields of their own (``object.member``), each
    element of an array counts as a value, nulls don't.  One pass takes all
    levels apart; how many there are is measured first.
    """
    levels = bodies.agg(F.max(depth(F.col("source")))).first()[0] or 0
    none = F.lit(None).cast("string")
    rows = bodies.where(is_object(F.col("source"))).select(none.alias("field"), body(F.col("source")).alias("value"), none.alias("type"))
    for _ in range(levels + 1):
        rows = rows.select(F.inline(members(F.col("field"), F.col("value"), F.col("type"))))
    return rows.where("type is not null").groupBy("field", "type").agg(F.count("*").alias("n"))


def from_documents(table: DataFrame) -> DataFrame:
    """The table ``documents``: its first line is the title, language and source are tags."""
    return table.select(
        "doc_id",
        F.array(F.substring_index("text", "\n", 1)).alias("title"),
        F.array("text").alias("content"),
        F.array("lang", "source").alias("tags"),
    )


def from_events(table: DataFrame) -> DataFrame:
    """The table ``events`` as a write log: a user's id, errors delete, all else writes its properties."""
    return table.select(
        F.col("user_id").alias("doc_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("index").alias("op"),
        F.col("props").alias("source"),
    )


def json_lines(spark: SparkSession, path: str, id_field: str = "id") -> DataFrame:
    """(doc_id, source) from files with a JSON object on each line, the id a member of it."""
    lines = spark.read.text(path).withColumnRenamed("value", "source").where("trim(source) <> ''")
    return lines.select(F.try_variant_get(F.try_parse_json("source"), f"$.{id_field}", "string").alias("doc_id"), "source")
