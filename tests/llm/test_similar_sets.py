"""Classes of similar shingle sets against all pairs, and the pipeline's stage."""

import random

import corpus_pipeline
import numpy as np
from test_simhash import plain

from lodestone.llm import similar_sets
from lodestone.llm.similar_sets import DIFFER, candidates, levels_and_tries, similar_classes


def plain_set(text, k=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def plain_classes(texts):
    sets, label = [plain_set(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def edited(base, edits, rng):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def texts_of(seed, groups, members):
    rng, out = random.Random(seed), [None, "", " \n", "one", "ONE", "two words"]
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 200))]
        out += [edited(base, rng.randrange(1 + len(base) // 30), rng) for _ in range(members)]
    return out


def linked(texts):
    """The (i, j) pairs of texts with different sets that are similar."""
    sets = [plain_set(t) for t in texts]
    return [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] != sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def found(spark, texts):
    rows = [(7 * i, t) for i, t in enumerate(texts)]
    got = {r["number"]: r["class"] for r in similar_classes(spark.createDataFrame(rows, "number long, text string").repartition(3)).collect()}
    assert sorted(got) == [7 * i for i in range(len(texts))]
    return [got[7 * i] // 7 for i in range(len(texts))]


def test_classes_as_all_pairs(spark):
    texts = texts_of(1, 30, 5)
    assert found(spark, texts) == plain_classes(texts)


def test_small_subtrees(spark, monkeypatch):
    """Many tries of few nodes: no link is false, and most are found."""
    monkeypatch.setattr(similar_sets, "SUBTREE", 16)
    monkeypatch.setattr(similar_sets, "LARGEST", 32)
    texts = texts_of(2, 3, 60) + texts_of(4, 60, 3)
    got, want, links = found(spark, texts), plain_classes(texts), linked(texts)
    assert len({(a, b) for a, b in zip(got, want, strict=True)}) == len(set(got))  # classes are parts of the true ones
    assert len(links) > 500 and sum(got[i] == got[j] for i, j in links) >= 0.9 * len(links)


def test_no_link_is_left_out(spark, monkeypatch):
    """What tries miss, here nearly all, prefixes find: also in tasks that take a few rows at a time."""
    monkeypatch.setattr(similar_sets, "SUBTREE", 2)
    monkeypatch.setattr(similar_sets, "LARGEST", 4)
    monkeypatch.setattr(similar_sets, "levels_and_tries", lambda n: (12, 1))
    texts = texts_of(2, 3, 20) + texts_of(4, 80, 2)
    common = " ".join(f"c{i}" for i in range(40))
    texts += [f"{common} {t}" for t in texts_of(6, 30, 2)[6:]]
    want = plain_classes(texts)
    assert found(spark, texts) == want
    monkeypatch.setattr(similar_sets, "FREQUENT", 5)
    assert found(spark, texts) == want


def test_prefixes_and_parities():
    rng = np.random.default_rng(8)
    frequent, counts = np.arange(0, 300, 3, dtype=np.uint64), rng.integers(2, 9, 100)
    for n in [*range(1, 30), 64, 200, 301]:
        a = np.sort(rng.choice(900, n, replace=False)).astype(np.uint64)
        for cut in range(n // 5 + 1):
            for b in (np.delete(a, rng.choice(n, cut, replace=False)), np.unique(np.concatenate([np.delete(a, rng.choice(n, cut // 2, replace=False)), rng.choice(900, cut // 2).astype(np.uint64)]))):
                if len(b) and similar_sets.similar(a, b):
                    assert np.intersect1d(similar_sets.prefix(a, frequent, counts), similar_sets.prefix(b, frequent, counts)).size
                assert similar_sets.differing(similar_sets.parities(a), similar_sets.parities(b)) <= len(np.setxor1d(a, b))
    one, other = (np.sort(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (5000, 700))  # of unlike lengths, folded
    assert 700 < similar_sets.differing(similar_sets.parities(one), similar_sets.parities(other)) <= 5700


def test_sharing_is_every_pair_of_classes(monkeypatch):
    monkeypatch.setattr(similar_sets, "TOGETHER", 7)
    rng = np.random.default_rng(9)
    rows = np.array(sorted({(int(t), int(n) % 9, int(n), 100 + 5 * (int(n) % 11), (int(t) * int(n)) % 30) for t, n in rng.integers(0, 40, (400, 2))}))
    got = {p for a, b in similar_sets.sharing(*rows.T) for p in zip(a.tolist(), b.tolist(), strict=True)}
    may = lambda n, m, i, j: 9 * (i + j) <= n + m and 9 * min(n - i, m - j) >= 4 * (n + m)
    pairs = [(x, y) for x in rows.tolist() for y in rows.tolist() if x[0] == y[0] and x[1] != y[1] and x[2] < y[2]]
    want = {(x[2], y[2]) for x, y in pairs if may(x[3], y[3], x[4], y[4])}
    assert got == want and 0 < len(want) < len({(x[2], y[2]) for x, y in pairs})


def test_copies_that_no_levels_tell_apart(spark, monkeypatch):
    monkeypatch.setattr(similar_sets, "SUBTREE", 4)
    monkeypatch.setattr(similar_sets, "LARGEST", 8)
    base = [f"w{i}" for i in range(4000)]
    texts = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(0, 4000, 40)] + ["alone"]
    got = found(spark, texts)
    assert set(got[:-1]) == {0} and got[-1] == len(texts) - 1


def test_candidates_come_once_and_go_on():
    """Turn after turn, candidates that fail leave others to be tried, until all pairs were."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 4, dtype=np.uint64)
    prints = np.array(sorted((base ^ np.array([1 << int(b) for b in rng.integers(0, 64, 4)], np.uint64)).tolist() for _ in range(12)), np.uint64)
    path, tried, history = prints[:, 0].copy(), [], [np.arange(12)]
    while True:
        x, y = candidates(path, prints, 0, history)
        if not len(x):
            break
        tried += zip(x.tolist(), y.tolist(), strict=True)
        history.append(np.arange(12))  # none of them verified
    assert len(tried) == len(set(tried)) == 66


def test_candidates_are_of_different_classes():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, similar_sets.LANES, dtype=np.uint64)
    prints = base ^ (np.uint64(1) << rng.integers(0, 64, (60, similar_sets.LANES), dtype=np.uint64))
    prints = prints[np.argsort(prints[:, 0])]
    history = [np.arange(60)]
    for groups in (40, 20, 20, 20, 6, 6):
        label = np.arange(60) % groups
        history.append(label)
        x, y = candidates(prints[:, 0].copy(), prints, 0, history)
        assert len(x) >= groups - 1 and (label[x] != label[y]).all()


def test_levels_and_tries():
    assert levels_and_tries(0) == levels_and_tries(500) == levels_and_tries(2000) == (0, 1)
    for n in (10**4, 10**6, 10**9):
        levels, tries = levels_and_tries(n)
        assert n / 2**levels <= similar_sets.SUBTREE and (1 - (1 - DIFFER) ** levels) ** tries <= similar_sets.MISSED


def test_nothing(spark, frame):
    assert found(spark, []) == []
    assert corpus_pipeline.near_copies(spark, frame([]), "").count() == 0


def test_stage_finds_pairs_that_fingerprints_miss(spark, frame):
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    near = next(t for t in (edited(base, 6, rng) for _ in range(1000)) if (plain(t, 5) ^ plain(" ".join(base), 5)).bit_count() > 4)
    assert len(plain_set(near) & plain_set(" ".join(base))) >= 0.8 * len(plain_set(near) | plain_set(" ".join(base)))
    kept = corpus_pipeline.near_copies(spark, frame([" ".join(base), near, "something else"]), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]
