"""Analyzers: text to terms, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word boundaries (letters with marks, joined by : . ' ’ · between
# letters; digits, joined by . , ; ' ’ between digits; underscores).  Possessive
# repeats: Java then matches in a loop, however long a word is.
WORD = r"(?:\p{L}[\p{L}\p{M}]*+(?:[:.'’·]\p{L}[\p{L}\p{M}]*+)*+|\p{N}[\p{N}\p{M}]*+(?:[.,;'’]\p{N}[\p{N}\p{M}]*+)*+|_++)++"
ALONE = r"([\p{IsHan}\p{IsHiragana}])"
TOGETHER = r"([\p{IsKatakana}ー]+)"


def standard(text: Column) -> Column:
    """Small-letter words; each Han or Hiragana character and each Katakana run is one."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(text), ALONE, " $1 "), TOGETHER, " $1 ")
    return F.regexp_extract_all(spaced, F.lit(WORD), F.lit(0))


def standard_values(values: Column) -> Column:
    """The terms of all values of a field, one value after the other."""
    return F.coalesce(F.flatten(F.transform(F.filter(values, lambda v: v.isNotNull()), standard)), F.array().cast("array<string>"))


def keyword_values(values: Column) -> Column:
    """Each distinct value is a term, as it is."""
    return F.coalesce(F.array_distinct(F.filter(values, lambda v: v.isNotNull())), F.array().cast("array<string>"))


def terms(kind: str, values: Column) -> Column:
    return keyword_values(values) if kind == "keyword" else standard_values(values)
