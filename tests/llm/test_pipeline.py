"""The pipeline's stages on the smallest tables: what goes and what stays."""

import random
import re

import corpus_pipeline
from test_similar_sets import linked

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = {tuple(w[j : j + 10]) for w in map(words, bench) for j in range(max(1, len(w) - 9))}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        if name == "packing":
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        assert after.keys() <= before.keys()
        gone = before.keys() - after.keys()
        if name == "quality":
            known = [labels[i] for i in before if i in labels]
            assert sum(labels[i] for i in after if i in labels) >= 0.95 * sum(known) and any(labels.get(i) == 0 for i in gone)
        if name == "near_copies":
            texts = {i: r["text"] for i, r in before.items()}
            of, kept = list(texts), [texts[i] for i in after]
            near = {of[i] for pair in linked(list(texts.values())) for i in pair} | {i for i in of if list(texts.values()).count(texts[i]) > 1}
            assert gone and gone <= near and not linked(kept) and len(set(kept)) == len(kept)
        if name == "repeats":
            assert not gone and all(len(r["text"]) == r["n_chars"] <= before[i]["n_chars"] for i, r in after.items())
        if name == "decontamination":
            held = lambda r: any(tuple(w[i : i + 10]) in windows for w in [words(r["text"])] for i in range(len(w) - 9))
            assert gone == {i for i, r in before.items() if held(r)}
        before = after
    rows = docs.collect()
    assert {r["doc_id"] for r in rows} == set(before) and max(r["length"] for r in rows) <= 1024


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_near_copies_keeps_one_row_of_a_class(spark, frame):
    ids = [4, 4, None, 4, None, 9, None]
    texts = ["a b c d e f", "a b c d e f", "a b c d e f", "other words here", "no id", "no id", "alone"]
    kept = corpus_pipeline.near_copies(spark, frame(texts, ids), SF)
    assert kept.columns == frame([]).columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("4", "a b c d e f"), ("4", "other words here"), ("9", "no id"), ("None", "alone")]


def odd_rows(spark):
    """Null and repeated ids, null, empty and very long texts, ties, and columns with the names that stages use."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(["the", "house", "and", "Garden", "of", "tion", "w" + str(rng.randrange(10**6))]) for _ in range(n))
    texts = [None, None, "", " ", "one", "one", *(prose(80) for _ in range(20)), prose(60_000)]
    texts += [texts[8], texts[8], texts[9] + " more", texts[10] + " " + prose(20)]
    ids = [None, 1, 2, 2, 3, 3, *range(10, 10 + len(texts) - 8), None, 10]
    rows = [(i, t, "en", f"src{k % 3}", len(t) if t is not None else None, 0.5, k, "x", "y", 7, b"z") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, number int, row string, kept string, `class` int, codes binary").repartition(3)


def test_stages_on_odd_rows(spark):
    docs = odd_rows(spark)
    told = lambda df: sorted(map(repr, df.collect()))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        if name == "packing":
            pieces = after.collect()
            assert len(pieces) >= docs.count() and sum(r["length"] for r in pieces if r["start"] == 0) > 0
            continue
        assert after.schema.simpleString() == docs.schema.simpleString()
        kept = after.count()
        if name == "quality":
            assert set(told(after)) <= set(told(docs))
        if name == "near_copies":
            blank = [r for r in after.collect() if not (r["text"] or "").strip()]
            assert len(blank) == 1 and blank[0]["doc_id"] == 1
            assert kept == docs.count() - 3 - 1 - 2 - 1 and set(told(after)) <= set(told(docs))
        if name == "repeats":
            by = {r["number"]: r for r in after.collect()}
            assert kept == docs.count() and all((by[r["number"]]["text"] is None) == (r["text"] is None) for r in docs.collect())
        if name == "decontamination":
            assert told(after) == told(docs)


def test_stages_on_an_empty_table(spark):
    none = odd_rows(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, none, SF)
        assert after.count() == 0 and (name == "packing" or after.columns == none.columns)
