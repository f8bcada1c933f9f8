"""Quality and language: learned on some rows, measured on others."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.entries import id_remainder, op2_quality, op7_language_id
from lodestone.llm import language_id, quality
from lodestone.llm.language_id import identify_language
from lodestone.llm.quality import fit, score_quality, train

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    rows = op2_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 1]) > 0.97


def test_quality_edge_cases(spark, frame):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["good", "words", "here", "and", "there"]) for _ in range(30)) if i % 2 else "$$$ " * 30 for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 0), (3, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    vectors, model = train(frame(texts), labels, sample=50)
    scored = {r["doc_id"]: r["score"] for r in score_quality(frame([*texts, None, "", "\n", "x" * 200_000]), vectors, model).collect()}
    assert len(scored) == 64 and all(0 <= s <= 1 for s in scored.values())
    assert all((scored[i] > 0.5) == (i % 2 == 1) for i in range(60)) and scored[60] == scored[61]
    none, flat = train(frame(texts), labels.where("false"))
    assert {r["score"] for r in score_quality(frame(texts), none, flat).collect()} == {0.5}
    assert score_quality(frame([]), vectors, model).count() == 0


def test_temperature_and_single_class():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(400, 5)), (rng.random(400) < 0.5).astype(float)
    m = fit(x, y, np.ones(400), np.arange(400) % 4 == 0)
    assert m.temperature > 1.5  # noise: confident logits are cooled
    assert fit(x, np.ones(400), np.ones(400), np.arange(400) % 4 == 0).probabilities(x[:3]).tolist() == [1.0] * 3


def prose(seed, n):
    rng = random.Random(seed)
    marks = ["good", "words", "Here", "and", "there", "!!", "x.y", "é", "\n"]
    return [" ".join(rng.choice(marks) for _ in range(rng.randrange(40))) + (" $$$ buy" * rng.randrange(4) if i % 2 else "") for i in range(n)]


def plain_words(text):
    return [zlib.crc32(w.encode()) % quality.BUCKETS for w in re.findall(r"\w+|[^\w\s]+", text)]


def test_word_vectors_as_plain_sums(frame, monkeypatch):
    monkeypatch.setattr(quality, "TOGETHER", 50)
    texts = [*prose(3, 40), " ".join(prose(4, 30)), "", "one"]
    index, want = quality.index_vectors(), {}
    for words in map(plain_words, texts):
        for i, w in enumerate(words):
            for j in range(max(0, i - quality.REACH), min(len(words), i + quality.REACH + 1)):
                if j != i:
                    want[w] = want.get(w, 0) + index[words[j]]
    got = quality.corpus_contexts(frame(texts))
    assert set(np.flatnonzero(got.any(1))) <= want.keys() and all((got[w] == v).all() for w, v in want.items())


def test_scores_as_a_plain_forward_pass(spark, frame):
    texts = prose(5, 80)
    vectors, m = train(frame(texts), spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int"))
    for r, text in zip(score_quality(frame(texts), vectors, m).orderBy("doc_id").collect(), texts, strict=True):
        words, n = plain_words(text), max(1, len(plain_words(text)))
        x = [sum(float(vectors[w][d]) for w in words) / n for d in range(quality.DIMENSIONS)]
        x += [math.log1p(len(words)) / 10, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n]
        x += [sum(c != c.lower() for c in text) / max(1, len(text)), len(text) / n / 10, text.count("\n") / n, float(not words)]
        z = [(v - a) / b for v, a, b in zip(x, m.mean, m.scale, strict=True)]
        hidden = [math.tanh(sum(v * w for v, w in zip(z, m.w1[:, k], strict=True)) + m.b1[k]) for k in range(quality.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, m.w2, strict=True)) + m.b2
        assert math.isclose(r["score"], 1 / (1 + math.exp(-logit / m.temperature)), abs_tol=1e-9)


def test_sample_is_bounded_where_ids_repeat(spark, frame, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    fitted = []
    monkeypatch.setattr(quality, "fit", lambda x, *rest: fitted.append(len(x)) or fit(x, *rest))
    docs = frame([f"text {i}" for i in range(3000)], [7] * 2900 + list(range(100)))
    train(docs, labels, sample=10)
    assert fitted == [10]


def plain_bayes(texts, learn):
    def buckets(text):
        codes, out = [*map(ord, text.lower()), 0, 0], []
        for i in range(len(codes) - 2):
            h = 0
            for k in range(3):
                h = ((h ^ codes[i + k]) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
                out.append(h >> 7 & language_id.BUCKETS - 1)
        return out

    counts, seen = {}, {}
    for text, lang in learn:
        if text is not None and lang is not None:
            own = counts.setdefault(lang, {})
            seen[lang] = seen.get(lang, 0) + 1
            for b in buckets(text):
                own[b] = own.get(b, 0) + 1
    for text in texts:
        if not text or not any(c.isalpha() for c in text):
            yield "und", 0.0
            continue
        logs = {}
        for lang in sorted(counts):
            total = sum(counts[lang].values()) + language_id.SMOOTHING * language_id.BUCKETS
            logs[lang] = math.log(seen[lang] / sum(seen.values())) + sum(math.log((counts[lang].get(b, 0) + language_id.SMOOTHING) / total) for b in buckets(text))
        best = max(sorted(logs), key=logs.get)
        yield best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())


def test_languages_as_plain_bayes(spark, frame, monkeypatch):
    monkeypatch.setattr(language_id, "CHUNK", 60)
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))
    make = lambda letters: " ".join(word(letters) for _ in range(rng.randrange(9)))
    kinds = {"aa": "abcde ", "bb": "bcdefg", "cc": "特許abÉ"}
    learn = [(make(kinds[k]), k) for k in rng.choices(list(kinds), k=60)] + [(None, "aa"), ("b", None)]
    texts = [None, "", "½ ² Ⅷ 12", "Ⅷa", *(make(kinds[k]) for k in rng.choices(list(kinds), k=40))]
    got = {r["doc_id"]: r for r in identify_language(frame(texts), spark.createDataFrame(learn, "text string, lang string")).collect()}
    for i, (lang, sure) in enumerate(plain_bayes(texts, learn)):
        assert got[i]["lang_pred"] == lang and math.isclose(got[i]["score"], sure, rel_tol=1e-9)


def test_equal_posteriors_and_too_many_languages(spark, frame):
    learn = spark.createDataFrame([("same words", "zz"), ("same words", "mm")], "text string, lang string")
    rows = identify_language(frame(["same words", "other"]), learn).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("mm", 0.5)}
    many = spark.createDataFrame([("a", f"l{i}") for i in range(language_id.LANGUAGES + 1)], "text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        identify_language(frame(["a"]), many)


def test_languages_on_held_out_rows(spark):
    rows = op7_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97


def test_language_edge_cases(spark, frame):
    docs = frame([None, "", "123 !!", "日本", "the house and the garden", "das haus und der garten", "x" * 3_000_000])
    learn = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und das tier", "de"), (None, "fr"), ("les", None)], "text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_language(docs, learn).collect()}
    assert [got[i] for i in range(3)] == [("und", 0.0)] * 3
    assert got[4][0] == "en" and got[5][0] == "de" and {got[3][0], got[6][0]} <= {"en", "de"} and all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in identify_language(docs, learn.where("false")).collect()} == {"und"}
    assert identify_language(frame([]), learn).count() == 0


@pytest.mark.parametrize("divisor", [4, 5])
def test_remainder_is_of_the_ids_text(spark, divisor):
    import zlib

    rows = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", id_remainder(divisor).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["doc_id"]).encode()) % divisor for r in rows)
