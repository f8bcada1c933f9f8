"""The golden collection, by scan and by written index; rank order, sizes, plans."""

import pytest
from pyspark.sql import functions as F

from lodestone.errors import InvalidSize
from lodestone.functions.scoring import coded_length
from lodestone.operators.op_log import get
from lodestone.operators.postings import Scan, field_lengths, statistics
from lodestone.operators.search import field_scores, search, top
from lodestone.sources import index_files
from lodestone.sources.corpus import from_bodies

BODIES = [
    ("d1", '{"title": "Hello", "content": "World", "tags": ["greeting"]}'),
    ("d2", '{"title": "Hello world", "content": "hello hello again", "tags": ["Hello", "demo"]}'),
    ("d3", '{"title": "Patent search", "content": "hello there world", "tags": "greeting"}'),
    ("d4", '{"title": "特許 検索", "content": "人工知能の特許", "tags": []}'),
    ("d5", '{"content": "only content world", "year": 2024}'),
    ("d6", '{"title": "", "content": "", "tags": ["hello"]}'),
]
GOLDEN = {
    "hello": [("d1", 1.794028), ("d2", 1.452308), ("d6", 1.311258), ("d3", 0.919734)],
    "Hello": [("d1", 1.794028), ("d2", 1.452308), ("d3", 0.919734)],
    "hello world": [("d2", 3.974918), ("d1", 1.794028), ("d3", 1.485983), ("d5", 0.566249)],
    "hello hello": [("d1", 3.588056), ("d2", 2.904617), ("d3", 1.839468)],
    "greeting": [("d1", 0.754913), ("d3", 0.754913)],
    "Greeting": [],
    "特許": [("d4", 3.653435)],
    "zzz": [],
    "": [],
}


@pytest.fixture(scope="module")
def docs(spark):
    return from_bodies(spark.createDataFrame(BODIES, "doc_id string, source string"))


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return index_files.save(docs, str(tmp_path_factory.mktemp("index")))


@pytest.mark.parametrize("q", GOLDEN)
def test_golden(docs, index, q):
    for source in (Scan(docs), index):
        assert [(r["doc_id"], r["_score"]) for r in top(source, q).collect()] == GOLDEN[q]


def test_statistics(docs):
    assert {r["field"]: (r["n_docs"], r["avgdl"]) for r in statistics(field_lengths(docs)).collect()} == {"title": (4, 2.25), "content": (5, 3.4), "tags": (4, 1.25)}


def test_winning_field_is_the_maximum_not_the_sum(docs):
    row = field_scores(Scan(docs), "hello").where("doc_id = 'd2'").first()
    assert row["_score"] == row["title_score"] > row["content_score"] > 0 and row["tags_score"] is None


def test_coded_lengths(spark, docs):
    lengths = [0, 23, 24, 39, 40, 41, 42, 56, 57, 100, 1000, 4999]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in lengths], "dl int").select(coded_length(F.col("dl"))).collect()]
    assert got == [n if n < 24 else 24 + ((n - 24) >> (s := max(0, (n - 24).bit_length() - 4)) << s) for n in lengths]
    assert got[4:6] == [40, 40] and got[9:11] == [96, 984]
    short = field_scores(Scan(docs), "hello").orderBy("doc_id").collect()
    assert field_scores(Scan(docs), "hello", coded=True).orderBy("doc_id").collect() == short


def test_sizes(docs):
    whole = [r["doc_id"] for r in top(Scan(docs), "hello", 10).collect()]
    for k in range(5):
        assert [r["doc_id"] for r in top(Scan(docs), "hello", k).collect()] == whole[:k]
    for bad in (-1, 10_001):
        with pytest.raises(InvalidSize):
            top(Scan(docs), "hello", bad)


def test_score_wins_over_a_column_of_its_name(docs):
    found = search(Scan(docs.withColumn("_score", F.lit(99.0))), "hello", 1).collect()
    assert [(r["doc_id"], r["_score"]) for r in found] == [("d1", 1.794028)]


def test_empty_collection(spark, docs):
    assert top(Scan(docs.limit(0)), "hello").collect() == []


def test_unmatched_field_changes_no_rank(docs):
    more = docs.withColumn("tags", F.array_append("tags", F.lit("other tag")))
    assert [r["doc_id"] for r in top(Scan(more), "world").collect()] == [r["doc_id"] for r in top(Scan(docs), "world").collect()]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(index):
    best = plan(top(index, "hello world"))
    assert "TakeOrderedAndProject" in best and "BroadcastHashJoin" in best and "In(term" in best.replace("PushedFilters: [", "")
    for node in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInArrow"):
        assert node not in best
    assert best.count("hashpartitioning(doc_id") == 1  # one shuffle of scores
    assert "EqualTo(doc_id,d1)" in plan(get(index.docs, "d1"))
    assert "In(doc_id, [" in plan(search(index, "hello world"))  # bodies are looked up, not scanned


def test_plan_after_writes(spark, docs, index, tmp_path):
    """Terms are still a filter on the scans of postings, and scores are shuffled once."""
    changed = docs.where("doc_id in ('d2', 'd5')")
    index_files.save_tail(index, changed.select("doc_id"), changed.where("doc_id = 'd2'"), str(tmp_path / "tail"))
    layered = index_files.load_tail(index, str(tmp_path / "tail"))
    best = plan(top(layered, "hello world"))
    scans = [line for line in best.splitlines() if "FileScan parquet [term#" in line]
    assert len(scans) >= 4 and all("In(term" in line for line in scans)  # postings and terms, of the index and of its tail
    assert best.count("hashpartitioning(doc_id") == 1 and "TakeOrderedAndProject" in best
    for node in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInArrow"):
        assert node not in best
    left = docs.where("doc_id <> 'd5'")
    for q in GOLDEN:
        assert top(layered, q).collect() == top(Scan(left), q).collect()


def test_texts_are_analysed_once_in_a_scan(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "docs"))
    found = field_scores(Scan(spark.read.parquet(str(tmp_path / "docs"))), "hello world")
    assert found.count() == 4
    found.collect()
    assert "ReusedExchange" in plan(found)
