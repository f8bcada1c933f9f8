"""Windows, hits and longest matches against plain Python."""

import random
import re
import tracemalloc

import pytest

import lodestone.llm.decontamination as module
from lodestone.llm.decontamination import benchmark_hits, decontaminated


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(texts, items, window):
    spots = {}
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            spots.setdefault(tuple(w[j : j + n]), set()).update([] if name is None else [str(name)])
    out = []
    for text in texts:
        w, hit, met = words(text), set(), set()
        for win, names in spots.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    met |= names
        out.append((len(w), len(hit), sorted(met)))
    return out


def longest(text, item, least):
    a, b = words(text), words(item)
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best if best >= min(least, len(b)) else 0


def cases(seed):
    rng = random.Random(seed)
    make = lambda n: " ".join(rng.choice(["a", "B", "c", "é", "d2", "the-end", "x"]) for _ in range(n))
    items = [(k, make(rng.choice([0, 1, 2, 4, 5, 6, 9, 14]))) for k in range(12)] + [(20, None), (None, "a a a a a"), (21, "..."), (None, "the end the end d2"), (5, "x x")]
    items.append((13, items[5][1]))
    texts = [None, "", "!!", *(make(rng.randrange(60)) for _ in range(25))]
    texts += [f"q q {items[7][1]} q {items[8][1]}", f"{items[9][1]}".upper(), texts[10], texts[10]]
    return texts, items


@pytest.mark.parametrize("seed", range(4))
def test_hits(spark, frame, monkeypatch, seed):
    monkeypatch.setattr(module, "SHARD_BYTES", 200)
    monkeypatch.setattr(module, "BLOCK_BYTES", 10**9 if seed % 2 else 60)
    monkeypatch.setattr(module, "TOGETHER", 10**6 if seed < 2 else 3)
    texts, items = cases(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in benchmark_hits(frame(texts), bench, window=5).collect()}
    want = plain(texts, items, 5)
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) for i in range(len(texts))] == want
    named: dict = {}
    for k, t in items:
        named.setdefault(str(k), []).append(t)
    for i, text in enumerate(texts):
        for m in got[i]["matches"]:
            a, n = words(text), m["length"]
            assert any(a[m["doc_word"] : m["doc_word"] + n] == words(t)[m["item_word"] : m["item_word"] + n] for t in named[m["item_id"]])
            assert n == max(longest(text, t, 5) for t in named[m["item_id"]])
    clean = decontaminated(frame(texts), bench, 5)
    assert clean.columns == frame(texts).columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i, w in enumerate(want) if not w[1]]


def test_nothing(spark, frame):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in benchmark_hits(frame(["a b"]), bench).collect()] == [(2, 0, [])]
    assert benchmark_hits(frame([]), bench).count() == 0


def test_a_block_is_small():
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(5000)]
    items = [(str(k), " ".join(rng.choice(vocabulary) for _ in range(60)).encode()) for k in range(3000)]
    size = sum(len(t) for _, t in items)
    assert module.Block(items, 10).nbytes < 3 * size
    tracemalloc.start()
    block = module.Block(items, 10)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 5 * size and len(block.place) == 3000 * 51


def test_items_that_share_their_only_window():
    """A thousand items of one word: the work grows with the text, not with text times items."""
    block = module.Block([(str(k), b"yes") for k in range(1000)] + [("no", b"no no")], 10)
    counts, offsets, hit, found = module.shard_hits([b"yes " * 20_000, b"no"], block)
    assert counts.tolist() == [20_000, 1] and hit.sum() == 20_000
    assert found == [(0, 0, 1, 0, 0)] and len(block.names[0]) == 1000


def test_items_that_share_a_window_are_compared_in_turns(monkeypatch):
    monkeypatch.setattr(module, "TOGETHER", 7)
    items = [(str(k), f"a b c d e w{k} x".encode()) for k in range(40)]
    _, _, hit, found = module.shard_hits([b"q a b c d e w3 x", b"a b c d e"], module.Block(items, 5))
    assert hit.sum() == 12 and len(found) == 80
    assert {(t, i): n for t, i, n, _, _ in found} == {(t, i): 7 if (t, i) == (0, 3) else 5 for t in (0, 1) for i in range(40)}


def test_very_long_text(spark, frame):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(300)}" for _ in range(400_000))
    item = " ".join(long.split(" ")[200_000:200_030])
    r = benchmark_hits(frame([long]), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (r["n_words"], r["n_hit"], r["items"], r["matches"][0]["length"], r["matches"][0]["doc_word"]) == (400_000, 30, ["1"], 30, 200_000)
