import zlib

from lodestone.llm.sharding import assign_shards


def check(frame, texts, ids, shards):
    rows = assign_shards(frame(texts, ids), shards=shards).collect()
    assert len(rows) == len(texts)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((i is not None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True))
    by = {}
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in order]
    assert keys == sorted(keys)  # contiguous in id order
    sizes = [sum(r["size"] for r in by.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


def test_shards(frame):
    texts = [None, "", "é" * 50, *("x" * (i * 37 % 211) for i in range(200)), "y" * 3000, "same", "same"]
    check(frame, texts, list(range(len(texts))), 8)
    check(frame, texts, [None, None, *[5] * 50, *range(len(texts) - 52)], 8)
    check(frame, ["a"], [3], 40)
    check(frame, ["é" * 1_000_000, "b", "c", None], [1, 2, 3, 4], 3)
    assert assign_shards(frame([])).count() == 0
