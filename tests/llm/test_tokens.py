"""Token ids, counts, files and packing against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm.bpe import encoder
from lodestone.llm.entries import op8_token_counts
from lodestone.llm.packing import least_slack, pack_documents
from lodestone.llm.scratch import scratch_path
from lodestone.llm.token_counts import CACHE_SCHEMA, count_tokens, tokenizer_version
from lodestone.llm.token_files import Segment, encode_segment, read_document, read_ids, read_token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "heed", ",", ".", "!!", " ", "  ", "\n", " \n", "\n ", "'s", "1", "22", "é", "<|endoftext|>", "\x1c", " ", "特許", "\t", "...", "Añ", " "]
TEXTS = [None, "", " ", "one", "Hello, world.\nThe end.", "the  gap", "tail \n ", "<|endoftext|> inside", "é" * 40, "word, " * 3000, "Hello, world.\nThe end."]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=10))
def test_words_give_the_ids_of_the_whole(parts):
    text = "".join(parts)
    assert np.frombuffer(encoder(PATH).ids([text])[0], "<u4").tolist() == ids(text)


PIECES = ["house", "Äpfel", "ÿ", "x", ",", ".", "!!", "***", "_", "'s", "\n", "\n\n", ".\n", "9", "\xad", "\xa0", "ʼn", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_words_cut_at_marks_and_lines(parts):
    """Words of letters, marks and lines, together in one call, have the ids of the whole."""
    own, text = encoder(PATH), "a " + "".join(parts)
    assert [np.frombuffer(g, "<u4").tolist() for g in own.ids([text, text[1:], text + " é b"])] == [ids(text), ids(text[1:]), ids(text + " é b")]


def test_known_parts_of_words_are_not_asked_for_again(monkeypatch):
    import lodestone.llm.bpe as module

    own, refuse = module.Encoder(PATH), lambda texts: [] if not texts else pytest.fail(f"asked for {texts}")
    own.ids(["x garden house, Über!! tür.\nThe end"])
    own.ids(["x garden.\nÜber"])
    monkeypatch.setattr(own, "whole", refuse)
    text = "x house.\nThe tür!! garden.\nThe,"
    assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == ids(text)


def test_what_a_worker_keeps_is_bounded(monkeypatch):
    import lodestone.llm.bpe as module

    monkeypatch.setattr(module, "KEPT_BYTES", 200_000)
    own, rng = module.Encoder(PATH), random.Random(2)
    held = lambda kept: sum(len(w) + len(v) for w, v in kept.items())
    for turn in range(30):
        unspaced = ["".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(2000)) for _ in range(20)]
        texts = [*unspaced, *(f"a {t}" for t in unspaced[:3]), *(f"h{rng.random()} word{rng.random()} {rng.random()}," for _ in range(100))]
        got = own.ids(texts)
        if turn % 10 == 0:
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids(t) for t in texts]
        assert all(len(w) <= module.LONGEST_KEPT for kept in (own.words, own.older, own.heads) for w in kept)
        assert held(own.words) + held(own.heads) <= own.size < 400_000 and held(own.older) < 400_000


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, frame, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        whole = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        library = Tokenizer.from_file(path)
        whole = lambda t: library.encode(t, add_special_tokens=False).ids
    got = {r["doc_id"]: r for r in count_tokens(frame(TEXTS), path).collect()}
    assert {i: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for i, r in got.items()} == {i: (len((t or "").encode()), n := len(whole(t or "")), n > 512) for i, t in enumerate(TEXTS)}


def test_cache_is_used_and_appended(spark, frame):
    cache = scratch_path(spark, "cache")
    digests = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache)
    count_tokens(frame(["a b", "a b", None, "c"]), PATH, cache).collect()
    assert digests().count() == 3
    import hashlib

    of, told = tokenizer_version(PATH), bytearray(hashlib.sha256(b"told by the cache").digest())
    spark.createDataFrame([(of, told, 77), ("another version", told, 78)], CACHE_SCHEMA).write.mode("append").parquet(cache)
    assert sorted(r["n_tokens"] for r in count_tokens(frame(["told by the cache", "a b", "new"]), PATH, cache).collect()) == [1, 2, 77]
    assert digests().where("n_tokens < 77").count() == 4


def test_the_query_meets_a_filled_cache(spark):
    cache, sf = scratch_path(spark, "cache"), "/root/testdata/sf0.001"
    spark.conf.set("lodestone.token_cache", cache)
    try:
        first = sorted(map(tuple, op8_token_counts(spark, sf).collect()))
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
        known = stored.count()
        assert sorted(map(tuple, op8_token_counts(spark, sf).collect())) == first and spark.read.schema(CACHE_SCHEMA).parquet(cache).count() == known
        assert known == spark.read.parquet(f"{sf}/documents.parquet").select("text").distinct().count()
    finally:
        spark.conf.unset("lodestone.token_cache")


def test_counts_of_nothing(frame):
    assert count_tokens(frame([]), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_segments(values):
    segment = Segment(encode_segment(np.array(values, "<u4")))
    assert segment.all().tolist() == values and len(segment) == len(values)
    for i in range(0, len(values), 7):
        assert segment[i] == values[i]
    for a in range(0, len(values) + 1, 1 + len(values) // 9):
        assert segment.span(a, min(len(values), a + 600)).tolist() == values[a : a + 600]
    with pytest.raises(IndexError):
        segment[len(values)]


def test_ids_are_read_by_their_place(spark, frame, monkeypatch):
    """A token costs some hundred bytes of a file of many thousands, and no other segment is opened."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(400))) for _ in range(120)]
    monkeypatch.setattr("lodestone.llm.token_files.SEGMENT_IDS", 20_000)
    path = scratch_path(spark, "files")
    write_token_files(frame(texts, [i // 2 for i in range(120)]), path, PATH, end_id=2)
    rows = sorted(read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    whole = [i for r in rows for i in r["ids"]]
    assert len(whole) > 60_000 and [r["doc_id"] for r in rows] == [i // 2 for i in range(120)]
    for at in (0, 1, 20_500, len(whole) - 1):
        got, taken = read_ids(spark, path, at)
        assert got == [whole[at]] and taken < 400
    got, taken = read_ids(spark, path, 19_000, 5000)
    assert got == whole[19_000:24_000] and taken < 4 * 5000
    assert read_document(spark, path, 7) == [r["ids"] for r in rows if r["doc_id"] == 7] and read_document(spark, path, 999) == []
    for at in (-1, len(whole)):
        with pytest.raises(IndexError):
            read_ids(spark, path, at)


def test_files(spark, frame, monkeypatch):
    import lodestone.llm.token_files as module

    monkeypatch.setattr(module, "SEGMENT_IDS", 50)
    order = list(range(len(TEXTS)))
    random.Random(1).shuffle(order)
    path = scratch_path(spark, "files")
    write_token_files(frame([TEXTS[i] for i in order], order), path, PATH, end_id=2)
    at = 0
    for i, r in enumerate(sorted(read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r["doc_id"])):
        want = [*ids(TEXTS[i]), 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i, at, len(want), want)
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)


def test_files_of_nothing_and_without_ids(spark, frame):
    path = scratch_path(spark, "files")
    write_token_files(frame([]), path, PATH)
    assert read_token_files(spark, path).count() == 0
    path = scratch_path(spark, "files")
    write_token_files(frame(["a", "b c", "b c"], [None, 5, 5]), path, PATH)
    assert sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in read_token_files(spark, path).collect()) == [(0, None, 2), (2, 5, 3), (5, 5, 3)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8), st.integers(1, 20))
def test_least_slack_is_least(lengths, room):
    counts = [lengths.count(n) for n in range(room + 1)]
    taken = least_slack(counts, room)
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= room}
    assert sum(n * k for n, k in taken) == max(sums) and all(k <= counts[n] for n, k in taken)


def test_packing(frame):
    texts = [*TEXTS, *(" ".join(f"w{i}x{j}" for j in range(i * 7)) for i in range(60))]
    rows = pack_documents(frame(texts), PATH, capacity=256, end_id=0, with_ids=True).collect()
    used, parts = {}, {}
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) and zlib.crc32(r["ids"]) == r["ids_crc32"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        parts.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
    for i, t in enumerate(texts):
        want = np.array([*ids(t), 0], "<u4")
        at = 0
        for start, piece, total in sorted(parts[i]):
            assert start == at and total == len(want)
            at += len(piece) // 4
        assert b"".join(p for _, p, _ in sorted(parts[i])) == want.tobytes()
    assert sorted(used) == list(range(len(used)))
    for windows in used.values():
        at = 0
        for offset, n in sorted(windows):
            assert offset == at
            at += n
        assert at <= 256
    assert sum(sum(n for _, n in w) < 256 for w in used.values()) <= 3  # the last window of each partition
    assert pack_documents(frame([]), PATH).count() == 0
