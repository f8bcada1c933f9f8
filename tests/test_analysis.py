"""Analyzer vectors, JSON values."""

import json

from pyspark.sql import functions as F

from lodestone.functions.analysis import keyword_values, standard, standard_values
from lodestone.functions.json_values import has_object, is_object, values
from lodestone.sources.corpus import dynamic_fields

VECTORS = {
    "Hello, World's foo.bar 3.14 a_b x-y hein.19 U.S.A. 1,000 a:b it’s a1.5b v2.": "hello world's foo.bar 3.14 a_b x y hein 19 u.s.a 1,000 a:b it’s a1.5b v2",
    "人工知能の特許 カタカナabc漢字テスト ひらがな データベース2": "人 工 知 能 の 特 許 カタカナ abc 漢 字 テスト ひ ら が な データベース 2",
    "straße ÉCOLE naïve user@example.com http://a.b/c?d=1 한국어 特許": "straße école naïve user example.com http a.b c d 1 한국어 特 許",
    "": "",
    " \n\t ... !!": "",
    "x" * 30_000: "x" * 30_000,
    "a1" * 20_000: "a1" * 20_000,
    "a.b" * 5_000: "a.b" * 5_000,
}


def test_standard_vectors(spark):
    rows = spark.createDataFrame([(t,) for t in VECTORS], "t string").select("t", F.array_join(standard(F.col("t")), " ").alias("w")).collect()
    assert {r["t"]: r["w"] for r in rows} == VECTORS


def test_values_are_analysed_one_after_the_other(spark):
    df = spark.createDataFrame([(["a b", None, "C"],), ([],), (None,)], "v array<string>")
    assert [r[0] for r in df.select(standard_values(F.col("v"))).collect()] == [["a", "b", "c"], [], []]
    df = spark.createDataFrame([(["Red fox", "Red fox", None, "red"],), (None,)], "v array<string>")
    assert [r[0] for r in df.select(keyword_values(F.col("v"))).collect()] == [["Red fox", "red"], []]


def test_json_values(spark):
    cases = {
        '{"f": "one"}': ["one"], '{"f": 3}': ["3"], '{"f": true}': ["true"], '{"f": ["a", 1, null]}': ["a", "1"], '{"f": [["x"], "y"]}': ["x", "y"],
        '{"f": [[["x", "y"]], [], [[["z"]]]]}': ["x", "y", "z"], '{"f": [[[[[null, 2.5, false]]]]]}': ["2.5", "false"],
        '{"f": ["a\\"]b", ["c\\\\", "[{,"], "\\u0022\\n é"]}': ['a"]b', "c\\", "[{,", '"\n é'],
        '{"f": {"a": 1}}': [], '{"f": null}': [], "{}": [], '{"f": []}': [], '{"f": 1.50}': ["1.5"], "not json": [], "[1]": [],
    }
    rows = spark.createDataFrame([(s,) for s in cases], "s string").select("s", values(F.col("s"), "f").alias("v"), is_object(F.col("s")).alias("o"), has_object(F.col("s"), "f").alias("h")).collect()
    assert {r["s"]: r["v"] for r in rows} == cases
    assert {r["s"] for r in rows if not r["o"]} == {"not json", "[1]"}
    assert [r["s"] for r in rows if r["h"]] == ['{"f": {"a": 1}}']


def test_objects_at_any_depth(spark):
    cases = {'{"f": [[[{"a": 1}]]]}': True, '{"f": ["{", ["\\"{"]]}': False, '{"f": "{"}': False, '{"g": {}}': False, '{"f": [[], {}]}': True, "{": False}
    rows = spark.createDataFrame([(s,) for s in cases], "s string").select("s", has_object(F.col("s"), "f").alias("h"), values(F.col("s"), "f").alias("v")).collect()
    assert {r["s"]: r["h"] for r in rows} == cases
    assert all(r["v"] == [] for r in rows if r["h"])


def test_long_strings_in_arrays(spark):
    long = "line \\ \"quoted\"\n" * 20_000
    deep = "[" * 200 + json.dumps(long) + "]" * 200
    row = spark.createDataFrame([('{"f": ' + deep + "}",)], "s string").select(values(F.col("s"), "f").alias("v"), has_object(F.col("s"), "f").alias("h")).first()
    assert row["v"] == [long] and not row["h"]


def test_dynamic_fields(spark):
    bodies = [
        '{"d": "2024-01-02", "t": "2024-01-02T03:04:05.678Z", "not": "2024-13-02", "y": "2024", "whole": 2.0, "n": 2, "big": 12345678901234567890, "e": 1e3}',
        '{"o": {"p": {"q": [1, "x", {"r": true}]}, "s": null}, "mixed": [1, "x", [[2.5, "2024-01-02"]]], "nested": [[1]], "empty": [], "void": {}}',
        "[1]", "no json", "{}",
    ]
    got = {(r["field"], r["type"]): r["n"] for r in dynamic_fields(spark.createDataFrame([(b,) for b in bodies], "source string")).collect()}
    assert got == dict.fromkeys(
        [("d", "date"), ("t", "date"), ("not", "text"), ("y", "text"), ("whole", "float"), ("n", "long"), ("big", "long"), ("e", "float")]
        + [("o", "object"), ("o.p", "object"), ("o.p.q", "long"), ("o.p.q", "text"), ("o.p.q", "object"), ("o.p.q.r", "boolean")]
        + [("mixed", "long"), ("mixed", "text"), ("mixed", "float"), ("mixed", "date"), ("nested", "long"), ("void", "object")], 1)
    assert dynamic_fields(spark.createDataFrame([], "source string")).count() == 0
