"""Fingerprints and classes against plain Python and all pairs."""

import random
import re

import numpy as np
import xxhash
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import simhash
from lodestone.llm.components import components
from lodestone.llm.simhash import _choices, fingerprint, near_duplicates, near_links, trie_links


def plain(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, budget=4):
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB é\n\t\x0b\x1c .", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text.encode()) == plain(text)


def near_values(n, seed, flips=6):
    rng, out = random.Random(seed), []
    for _ in range(n):
        base = rng.choice(out) if out and rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randrange(flips)):
            base ^= 1 << rng.randrange(64)
        out.append(base)
    return sorted(set(out))


def family(n, seed):
    """Values that differ in the last 20 bits alone: one trie has them all."""
    rng, base = random.Random(seed), random.Random(seed).getrandbits(64)
    return [base >> 20 << 20 | rng.getrandbits(20) for _ in range(n)]


def test_bits_in_another_order():
    rng = random.Random(1)
    word, order = rng.getrandbits(64), rng.sample(range(64), 64)
    want = "".join(f"{word:064b}"[i] for i in order)
    assert f"{int(simhash._in_order(np.array([word], np.uint64), np.array(order))[0]):064b}" == want


def test_large_tries_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TRIE_KEYS", 50)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in set(family(3000, 5))]
    dealt, written = simhash._dealt(spark.createDataFrame(signed, "bits long"), 4)
    assert len(signed) > 1000 and len(written) > 1
    assert dealt.groupBy("trie", "prefix").count().agg(F.max("count")).first()[0] <= 100


def test_trie_links_as_all_pairs():
    for seed in range(6):
        values = near_values(300, seed)
        got = trie_links(np.array(values, np.uint64), 0, 4)
        assert got.tolist() == classes(values)
    assert trie_links(np.zeros(0, np.uint64), 13, 4).tolist() == []
    assert trie_links(np.array([7], np.uint64), 13, 4).tolist() == [0]


def test_every_pair_meets():
    for n in (10, 10_000_000, 10**11):
        for choice in _choices(4, n):
            assert len(choice) >= 1
    assert len(_choices(4, 10)) == 5 and len(_choices(4, 10**9)) > 5


@pytest.mark.parametrize("trie_keys", [4096, 20])
def test_links_over_partitions(spark, monkeypatch, trie_keys):
    monkeypatch.setattr(simhash, "TRIE_KEYS", trie_keys)
    values = sorted(set(near_values(400, 9) + family(200, 3)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = near_links(spark.createDataFrame([(v,) for v in signed * 2], "bits long"))
    found = {r["node"]: r["label"] for r in components(links).collect()}
    got = [found.get(v, v) for v in signed]
    want = classes(values)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(frame):
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    texts = [None, "", " \n", "one", "ONE", "two words"]
    for _ in range(12):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(400)] = "edited"
        texts.append(" ".join(words))
    texts += texts[6:9]
    ids = [100 - i for i in range(len(texts))]
    label = classes([plain(t) for t in texts])
    smallest = {c: min(i for i, k in zip(ids, label, strict=True) if k == c) for c in set(label)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(frame(texts, ids)).collect()}
    assert got == {i: (f"{plain(t):016x}", smallest[c]) for i, t, c in zip(ids, texts, label, strict=True)}


def test_ids_that_are_null_or_repeat(frame):
    rows = near_duplicates(frame(["a b c d e", "a b c d e", None, "z"], [None, 4, 4, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows) == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
    assert near_duplicates(frame([])).count() == 0
    assert {r["component_id"] for r in near_duplicates(frame(["q", "q"], ["b", "a"], "string")).select(F.col("component_id")).collect()} == {"a"}


def test_very_long_text(frame):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(70_000))
    rows = {r["doc_id"]: r for r in near_duplicates(frame([long, long + " end", "short"])).collect()}
    assert rows[0]["fingerprint"] == f"{plain(long):016x}" and [rows[i]["component_id"] for i in range(3)] == [0, 0, 2]
