"""Values of a JSON body's fields, normalised to arrays of strings, and the types that they show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scalars of a JSON text whose strings hold no quote, and dates as ISO 8601 writes them.
STRING, SCALAR = r'"[^"]*+"', r'"[^"]*+"|[^\[\]{},:"\s]++'
DATE = r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:T(?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.,]\d{1,9})?)?)?(?:Z|[+-]\d\d:?\d\d)?)?$"


def body(source: Column) -> Column:
    """The parsed body; null for what isn't JSON."""
    return F.try_parse_json(source)


def is_object(source: Column) -> Column:
    return F.coalesce(F.schema_of_variant(body(source)).startswith("OBJECT"), F.lit(False))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _member(source: Column, field: str) -> Column:
    return F.try_variant_get(body(source), f"$.{field}", "variant")


def _plain(value: Column) -> Column:
    """A value's JSON text, with no quote inside strings: escaped backslashes, then quotes, as their numbers."""
    return F.replace(F.replace(F.to_json(value), F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))


def _holds_object(value: Column) -> Column:
    return F.coalesce(F.contains(F.regexp_replace(_plain(value), STRING, ""), F.lit("{")), F.lit(False))


def values(source: Column, field: str) -> Column:
    """A field's values as strings: a scalar is one value, arrays are flattened
    however deep they are, nulls go, numbers and booleans have their JSON form.
    A field that holds an object has no values.

    Arrays are read off their JSON text, whose scalars stand in order whatever
    brackets are around them, so that no depth is built into the plan.
    """
    value = _member(source, field)
    kind = _kind(value)
    one = F.array(F.try_variant_get(value, "$", "string"))
    many = F.transform(F.regexp_extract_all(_plain(value), F.lit(SCALAR), F.lit(0)), lambda t: F.try_variant_get(F.try_parse_json(t), "$", "string"))
    found = F.when(kind.startswith("ARRAY"), F.when(~_holds_object(value), many)).when(kind.startswith("OBJECT") | (kind == "VOID"), None).otherwise(one)
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda v: v.isNotNull())


def has_object(source: Column, field: str) -> Column:
    """Whether a field holds an object, alone or in arrays of any depth: no value of a text or keyword field."""
    return _holds_object(_member(source, field))


def depth(source: Column) -> Column:
    """How many objects and arrays of a body lie in each other."""
    brackets = F.split(F.regexp_replace(F.regexp_replace(_plain(body(source)), STRING, ""), r"[^\[\]{}]++", ""), "")
    step = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def move(at: Column, c: Column) -> Column:
        now = at["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.coalesce(F.aggregate(brackets, step, move, lambda at: at["most"]), F.lit(0))


def scalar_type(value: Column) -> Column:
    """The field type that a scalar gives a field: integers long, fractions float, ISO dates date; null for null.

    A number written with a fraction is parsed as a decimal even where that is
    zero, and whole numbers are only where they don't fit 64 bits.
    """
    kind = _kind(value)
    beyond = F.abs(F.try_variant_get(value, "$", "double")) >= 2.0**63
    return (
        F.when(kind == "BOOLEAN", "boolean")
        .when(kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), "long")
        .when(kind.rlike(r"^DECIMAL\(\d+,0\)$") & beyond, "long")
        .when(kind.startswith("DECIMAL") | kind.isin("FLOAT", "DOUBLE"), "float")
        .when(kind == "STRING", F.when(F.try_variant_get(value, "$", "string").rlike(DATE), "date").otherwise("text"))
    )


def members(field: Column, value: Column, known: Column) -> Column:
    """What a (field, value) holds, one level down, as (field, value, type): an
    object its members (``field.name``) and the type ``object`` of its own, an
    array its elements, a scalar its type; what has a type stays as it is."""
    kind = _kind(value)

    def row(f: Column, v: Column, t: Column) -> Column:
        return F.struct(f.cast("string").alias("field"), v.cast("variant").alias("value"), t.cast("string").alias("type"))

    none = F.lit(None)
    named = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda e: row(F.concat_ws(".", field, e["key"]), e["value"], none))
    own = F.when(field.isNotNull(), F.array(row(field, none, F.lit("object"))))
    each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda e: row(field, e, none))
    empty = F.filter(F.array(row(field, none, none)), lambda e: F.lit(False))
    return (
        F.when(known.isNotNull(), F.array(row(field, none, known)))
        .when(kind.startswith("OBJECT"), F.concat(F.coalesce(own, empty), named))
        .when(kind.startswith("ARRAY"), each)
        .otherwise(F.array(row(field, none, scalar_type(value))))
    )
