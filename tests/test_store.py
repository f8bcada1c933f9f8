"""Writes, reads, streaming ingest, connecting."""

import json
import random
import subprocess
import sys
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.errors import DocumentNotFound, InvalidDocument, InvalidQuery, InvalidSize
from lodestone.operators.op_log import delete_acks, index_acks, missing_deletes, settled, snapshot
from lodestone.operators.postings import Index, Layered, Scan
from lodestone.operators.search import search
from lodestone.session import connect, setting
from lodestone.sources.corpus import json_lines
from lodestone.store import DocumentStore
from lodestone.streaming.ingest import ingest


@pytest.fixture
def store(spark, tmp_path):
    return DocumentStore(spark, str(tmp_path))


def test_create_once(store):
    assert store.create_index_if_needed() and not store.create_index_if_needed() and store.exists()
    assert store.search("x") == []


def test_sequence(store):
    assert store.index("a", {"title": "v1", "only": 1})["result"] == "created"
    assert store.index("a", {"title": "v2"})["result"] == "updated"
    assert store.get("a") == {"title": "v2"}
    assert store.delete("a") == {"deleted": "a"}
    for missing in (store.get, store.delete):
        with pytest.raises(DocumentNotFound, match="Document not found"):
            missing("a")
    again = store.index("a", {"title": "v3"})
    assert (again["result"], again["_version"]) == ("created", 4)


def test_search_sees_writes_before_and_after_refresh(store):
    store.index("a", {"title": "Hello", "content": "World", "tags": ["greeting"], "_score": "own", "year": 2024})
    store.index("b", {"content": "hello again"})
    before = store.search("hello")
    assert [d["content"] for d in before] == ["hello again", "World"] and before[1]["year"] == 2024 and before[0]["_score"] > before[1]["_score"] > 0
    store.refresh()
    assert store.search("hello") == before
    store.delete("a")
    assert [d["content"] for d in store.search("hello")] == ["hello again"]
    assert store.search("hello", 0) == []
    with pytest.raises(InvalidSize):
        store.search("hello", -1)


def test_bodies_that_are_no_objects(store):
    for bad in ("[1]", "no json", {"title": {"a": 1}}, {"tags": ["x", {"a": 1}]}):
        with pytest.raises(InvalidDocument):
            store.index("a", bad)
    assert not store.exists()


def test_source_is_returned_as_it_was(store):
    body = '{"title": "t", "x": {"b": 1, "a": [1, 2.50]}, "tags": null}'
    store.index("a", body)
    assert store.get("a") == json.loads(body) and store.log().first()["source"] == body


def test_mapping(store):
    store.index("a", {"title": "t", "n": 3, "x": 1.5, "ok": True, "o": {"p": 1}, "tags": ["a"], "none": None})
    store.index("b", {"n": "three"})
    assert store.mapping() == {"title": ["text"], "n": ["long", "text"], "x": ["float"], "ok": ["boolean"], "o": ["object"], "o.p": ["long"], "tags": ["text"]}


def test_bulk_and_json_lines(spark, store, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id": "x", "title": "Red fox"}\n\n{"id": "y", "tags": ["Red fox"]}\n')
    store.index_all(json_lines(spark, str(tmp_path / "in.jsonl")))
    assert [d["id"] for d in store.search("Red fox")] == ["x", "y"]
    assert [d["id"] for d in store.search("red")] == ["x"]


OPS = st.lists(st.tuples(st.sampled_from("abc"), st.booleans()), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ops=OPS, order=st.randoms())
def test_log_against_a_dictionary(spark, ops, order):
    rows = [(k, i, "index" if put else "delete", f'{{"n": {i}}}' if put else None) for i, (k, put) in enumerate(ops)]
    state, version, acks, gone, missing = {}, {}, [], [], []
    for k, i, op, source in rows:
        if op == "index":
            version[k] = version.get(k, 0) + 1
            acks.append((k, i, version[k], "updated" if k in state else "created"))
            state[k] = source
        elif k in state:
            version[k] += 1
            del state[k]
            gone.append((k, i))
        else:
            missing.append((k, i))
    order.shuffle(rows)
    log = spark.createDataFrame(rows, "doc_id string, seq long, op string, source string")
    assert {r[0]: r[1] for r in snapshot(log).collect()} == state
    assert sorted(map(tuple, index_acks(log).collect())) == sorted(acks)
    assert sorted(map(tuple, delete_acks(log).collect())) == sorted(gone)
    assert sorted(map(tuple, missing_deletes(log).collect())) == sorted(missing)
    for parts in (1, 3, 50):
        ends = settled(log, parts).groupBy("doc_id").agg(F.max_by("version", "seq")).collect()
        assert {r[0]: r[1] for r in ends} == {k: version.get(k, 0) for k, *_ in rows}


def test_ingest_is_exactly_once(spark, store, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()

    def put(name, *ops):
        (inbox / name).write_text("".join(json.dumps(dict(zip(("doc_id", "seq", "op", "source"), o, strict=True))) + "\n" for o in ops))

    put("1.json", ("a", 1, "index", '{"title": "one"}'), ("b", 2, "index", '{"title": "two"}'))
    ingest(store, str(inbox), str(tmp_path / "check")).awaitTermination()
    put("2.json", ("b", 4, "delete", None), ("a", 3, "index", '{"title": "three"}'), ("a", 0, "index", '{"title": "late"}'))
    ingest(store, str(inbox), str(tmp_path / "check")).awaitTermination()
    ingest(store, str(inbox), str(tmp_path / "check")).awaitTermination()
    assert store.log().count() == 5 and store.get("a") == {"title": "three"}
    with pytest.raises(DocumentNotFound):
        store.get("b")
    store.append(store.log().where("false"), "stream-000000000000")  # a batch that is tried again replaces itself
    assert store.log().count() == 3
    assert store.index("c", {"title": "after the stream"})["_seq_no"] == 5


def test_versions_go_on_after_compaction(store):
    assert store.compact() is None and store.refresh() is None
    store.index("a", {"title": "v1"})
    store.index("a", {"title": "v2"})
    store.index("b", {"title": "b"})
    store.delete("b")
    first = store.compact()
    assert first == 4 and store.compact() == first and store.log().count() == 2
    assert store.index("a", {"title": "v3"})["_version"] == 3
    again = store.index("b", {"title": "b2"})
    assert (again["_version"], again["result"], again["_seq_no"]) == (3, "created", 6)
    store.compact()
    assert store.index("b", {"title": "b3"})["_version"] == 4 and store.get("a") == {"title": "v3"}
    store.delete("a")
    store.compact()
    with pytest.raises(DocumentNotFound):
        store.delete("a")
    assert store.index("a", {"title": "v4"}) == {"_id": "a", "result": "created", "_version": 5, "_seq_no": 9}


def test_log_does_not_grow(store):
    """However many writes there were, a write reads the appends since the last compaction."""
    for turn in range(4):
        store.index("a", {"title": f"v{turn}"})
        store.index("b", {"title": f"v{turn}"})
        store.compact()
        assert store._appends(store._newest("state", "appends")) == [] and store.log().count() == 2
        assert len(store._names("log")) <= 4 and len(store._names("claims")) == 1
        assert len([n for n in store._names() if n.startswith("state-")]) <= 2


def test_equal_numbers_are_ordered_by_their_append(spark, store):
    for origin, title in (("z", "last"), ("a", "first")):
        store.append(spark.createDataFrame([("x", 7, "index", json.dumps({"title": title}))], "doc_id string, seq long, op string, source string"), origin)
    assert store.get("x") == {"title": "last"} and store.last_seq() == 7
    store.compact()
    assert store.get("x") == {"title": "last"}


WRITER = """
import sys
from pyspark.sql import SparkSession
from lodestone.store import DocumentStore
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
store = DocumentStore(spark, sys.argv[1])
print([store.index("shared" if i == 2 else f"{sys.argv[2]}{i}", {"title": sys.argv[2]})["_seq_no"] for i in range(3)])
"""


def test_two_processes_take_different_numbers(store, tmp_path):
    run = [subprocess.Popen([sys.executable, "-c", WRITER, str(tmp_path), who], stdout=subprocess.PIPE, stderr=subprocess.PIPE, cwd=Path(__file__).parents[1], text=True) for who in "pq"]
    said = [p.communicate(timeout=300) for p in run]
    numbers = [n for out, err in said for n in json.loads(out.strip().splitlines()[-1])]
    assert len(numbers) == len(set(numbers)) == 6
    last = store.log().where("doc_id = 'shared'").orderBy(F.desc("seq")).first()
    assert store.get("shared") == json.loads(last["source"]) and len(store.search("p q", 10)) == 5


def same(found, wanted):
    return [(d["id"], d["_score"]) for d in found] == [(d["id"], d["_score"]) for d in wanted]


def test_index_survives_writes(spark, store):
    words = ["red", "fox", "blue", "dog", "特許", "the"]
    rng = random.Random(3)
    body = lambda i: {"id": i, "title": rng.choice(words), "content": " ".join(rng.choices(words, k=rng.randrange(9))), "tags": rng.choices(words, k=2)}
    bodies = [(f"d{i:02d}", json.dumps(body(i))) for i in range(40)]
    store.index_all(spark.createDataFrame(bodies, "doc_id string, source string"))
    store.refresh()
    assert isinstance(store.current(), Index)

    def check():
        for q in ("red fox", "the the", "特許", "dog", "nothing"):
            wanted = [json.loads(r["source"]) | {"_score": r["_score"]} for r in search(Scan(store.documents()), q, 50).collect()]
            assert same(store.search(q, 50), wanted)

    store.delete("d03")
    check()
    store.index("d05", {"id": 5, "title": "red dog dog", "tags": "fox"})
    store.index("new", {"id": 99, "content": "a red red fox"})
    store.index("d06", {"id": 6})
    assert isinstance(store.current(), Layered)
    check()
    tails = [n for n in store._names(f"index-{store._newest('index', 'stats')}") if n.startswith("tail-")]
    assert len(tails) == 2  # the present one and the one before
    store.compact()
    store.delete("new")
    assert isinstance(store.current(), Layered)
    check()
    store.refresh()
    assert isinstance(store.current(), Index)
    check()


def test_all_documents_are_deleted(store):
    store.index("a", {"title": "hello"})
    store.refresh()
    store.delete("a")
    assert store.search("hello") == []
    store.refresh()
    assert store.search("hello") == []
    store.index("b", {"title": "hello"})
    assert [d["title"] for d in store.search("hello")] == ["hello"]


def test_queries_of_too_many_words(store):
    store.index("a", {"title": "w1"})
    with pytest.raises(InvalidQuery):
        store.search(" ".join(f"w{i}" for i in range(1025)))


def test_connect(spark, monkeypatch):
    assert connect(2, 0, lambda: spark) is spark
    tried = []

    def fails():
        tried.append(1)
        raise OSError("down")

    with pytest.raises(RuntimeError):
        connect(3, 0, fails)
    assert len(tried) == 3
    monkeypatch.setenv("LODESTONE_PATH", "/elsewhere")
    assert setting("path", "here") == "/elsewhere" and setting("other", "here") == "here"
