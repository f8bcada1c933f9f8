"""Repeated windows and what is left of texts, against counting all windows."""

import random
from collections import Counter

import numpy as np
import pytest

import lodestone.llm.suffix_dedup as module
from lodestone.llm.suffix_dedup import WINDOW, remove_repeats, repeated_windows


def plain(texts):
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + WINDOW] for d in data for i in range(len(d) - WINDOW + 1))
    out = []
    for d in data:
        covered = bytearray(len(d))
        for i in range(len(d) - WINDOW + 1):
            if times[d[i : i + WINDOW]] > 1:
                covered[i : i + WINDOW] = b"\1" * WINDOW
        kept = bytes(b for b, c in zip(d, covered, strict=True) if not c)
        out.append((len(d), sum(covered), sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered)), kept))
    return out


def corpus(seed):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcde fghé\n") for _ in range(n))
    passages = [make(n) for n in (199, 200, 201, 260, 700)]
    texts = [None, "", "short", "x" * 199, "y" * 200, "z" * 201, "é" * 300, "ab" * 400, "cd " * 90, make(600)]
    for _ in range(25):
        text = make(rng.randrange(900))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(passages) + text[at:]
        texts.append(text)
    near = list(texts[-1] + passages[4])
    near[len(near) // 2] = "#"
    return [*texts, "".join(near), texts[12], texts[12], make(5000) + passages[0] + passages[0]]


@pytest.mark.parametrize(("runs", "hot"), [(1_000_000, 1_000_000), (40, 2), (40, 5)])
def test_documents(frame, monkeypatch, runs, hot):
    monkeypatch.setattr(module, "TASK_RUNS", runs)
    monkeypatch.setattr(module, "HOT_CONTENTS", hot)
    monkeypatch.setattr(module, "SCAN_BYTES", 3000)
    monkeypatch.setattr(module, "COLLECTION", 3)
    monkeypatch.setattr(module, "HELD_WINDOWS", 2000)
    for seed in (1, 2):
        texts = corpus(seed)
        got = {r["row"]["doc_id"]: r for r in remove_repeats(frame(texts)).collect()}
        assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for _, r in sorted(got.items())] == plain(texts)


def test_as_text_drops_cut_characters(frame):
    shared = "é" * 150
    texts = ["a" + shared + "è", "b" + shared + "ê", "left alone"]
    got = {r["row"]["doc_id"]: r["kept"] for r in remove_repeats(frame(texts), as_text=True).collect()}
    assert got == {i: k.decode("utf-8", "ignore") for i, (*_, k) in enumerate(plain(texts))}


def test_nothing_and_repeated_ids(frame):
    assert remove_repeats(frame([])).count() == 0
    assert [r["kept"] for r in remove_repeats(frame([None, ""]), as_text=True).orderBy("row.doc_id").collect()] == [None, ""]
    assert [bytes(r["kept"]) for r in remove_repeats(frame([None])).collect()] == [b""]
    rows = remove_repeats(frame(["p" * 250, "p" * 250, "q"], [None, 1, 1])).collect()
    assert sorted((r["row"]["doc_id"] or 0, r["n_removed"]) for r in rows) == [(0, 250), (1, 0), (1, 250)]


def test_a_window_of_many_documents_is_combined_in_each_task():
    """However many contexts a passage has, its windows go to the task that counts them once from each task."""
    import pyarrow as pa

    rng = random.Random(8)
    passage = bytes(rng.randrange(256) for _ in range(220))
    rows = [{"key": k, "size": 500, "start": 0, "copies": 1, "bytes": bytes([k] * 30) + passage + bytes([k] * 30)} for k in range(240)]
    tasks = [[b for b in module._windows(iter([pa.RecordBatch.from_pylist(rows[i::3])]), 4)] for i in range(3)]
    asked = np.concatenate([np.frombuffer(r["windows"], module._WINDOW) for t in tasks for b in t for r in b.to_pylist() if not r["known"]])
    alone = {"key": 1, "size": 220, "start": 0, "copies": 1, "bytes": passage}
    assert [r["known"] for b in module._windows(iter([pa.RecordBatch.from_pylist([alone])]), 1) for r in b.to_pylist()] == [False]
    first, _ = module.window_hashes(passage)
    assert all((asked["a"] == h).sum() == 3 for h in first)
    spans = [r for b in module._joined(module._counted((b for t in tasks for b in t), 4)) for r in b.to_pylist()]
    assert sorted((r["key"], r["start"], r["windows"]) for r in spans) == [(k, 30, 21) for k in range(240)]


def test_very_long_texts(frame):
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    passage = make(260)
    texts = [make(60_000) + passage + make(40_000), "tail " + passage, "ab" * 30_000]
    got = {r["row"]["doc_id"]: r for r in remove_repeats(frame(texts)).collect()}
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for _, r in sorted(got.items())] == plain(texts)


@pytest.mark.parametrize("seed", range(3))
def test_collection(seed):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab c") for _ in range(1500))
    segments = []
    for _ in range(60):
        a = rng.randrange(1200)
        s = bytearray(base[a : a + rng.randrange(200, 420)])
        for _ in range(rng.randrange(3)):
            s[rng.randrange(len(s))] = rng.choice(b"abxyz")
        segments.append(bytes(s))
    segments = list(dict.fromkeys([*segments, b"ab" * 150, b"xyz" * 80]))
    times = Counter(s[i : i + WINDOW] for s in segments for i in range(len(s) - WINDOW + 1))
    for s, flags in zip(segments, repeated_windows(segments), strict=True):
        assert np.array_equal(flags, [times[s[i : i + WINDOW]] > 1 for i in range(max(0, len(s) - WINDOW + 1))])


def batches_of(texts, size):
    import pyarrow as pa

    for i in range(0, len(texts), size):
        part = texts[i : i + size]
        yield pa.RecordBatch.from_arrays([pa.array([hash(t) for t in part], pa.int64()), pa.array(part, pa.string())], ["key", "text"])


@pytest.mark.parametrize("runs", [1, 60, 10**6])
def test_tasks_settle_what_they_can(monkeypatch, runs):
    """The steps by themselves, with tasks that send their runs on early."""
    monkeypatch.setattr(module, "TASK_RUNS", runs)
    monkeypatch.setattr(module, "SCAN_BYTES", 2000)
    monkeypatch.setattr(module, "COLLECTION", 3)
    texts = [t or "" for t in corpus(5)]
    long = [t for t in texts if len(t.encode()) >= WINDOW]
    scanned = [b for task in (long[::3], long[1::3], long[2::3]) for b in module._scan(batches_of(task, 4))]
    met = [r for b in module._meet(iter(scanned)) for r in b.to_pylist()]
    data, copies = {hash(t): t.encode() for t in long}, Counter(map(hash, long))
    rows = {(r["name"], r["content"], r["key"], r["start"], r["state"], data[r["key"]][r["start"] : r["start"] + r["windows"] + WINDOW - 1]) for r in met if r["state"] >= module.OPEN}
    import pyarrow as pa

    segments = pa.RecordBatch.from_pylist([{"name": n, "content": c, "key": k, "size": len(data[k]), "start": s, "state": st, "copies": copies[k], "bytes": b} for n, c, k, s, st, b in rows])
    spans = [(r["key"], r["start"], r["windows"]) for b in module._order(iter([segments])) for r in b.to_pylist()]
    spans += [(r["key"], r["start"], r["windows"]) for r in met if r["state"] in (module.WHOLE, module.PARTNER)]
    removed = Counter()
    for key in data:
        covered = bytearray(len(data[key]))
        for k, start, n in spans:
            if k == key:
                covered[start : start + n + WINDOW - 1] = b"\1" * (n + WINDOW - 1)
        removed[key] = sum(covered)
    assert [removed[hash(t)] for t in texts] == [n for _, n, _, _ in plain(texts)]
