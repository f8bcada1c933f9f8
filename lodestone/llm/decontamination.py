"""Benchmark passages in training documents, found with suffix arrays of their words."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import id_type, map_arrow, narrowed, utf8

#: Bytes of text in one shard, for which one suffix array is built.
SHARD_BYTES = 24_000_000
#: Bytes of benchmark text in one block; each block is searched by itself.
BLOCK_BYTES = 8_000_000
#: Windows searched together, and pairs of an occurrence and an item's place compared together.
TOGETHER = 200_000

#: ASCII capitals to small letters; every ASCII byte that isn't a digit or letter to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Block:
    """A block of benchmark items: word numbers (a zero after each item), and the places of windows, in suffix order.

    Items with the same words are one.  ``place`` has the places of all windows,
    equal ones next to each other; ``heads`` the first of each, and the end.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number, distinct = self.vocabulary.setdefault, {}
        for name, text in items:
            ids = np.array([number(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                distinct.setdefault(ids.tobytes(), []).append(name)
        self.names: list[list[str | None]] = list(distinct.values())
        sizes = np.array([len(k) // 4 for k in distinct], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.ids = np.frombuffer(b"".join(k + bytes(4) for k in distinct) + bytes(4 * window), np.int32)
        del distinct
        self.window, self.item_widths = window, np.minimum(sizes, window).astype(np.int32)
        self.least = int(self.item_widths.min()) if len(sizes) else 0
        starts = np.zeros(self.offsets[-1], bool)
        starts[_expand(self.offsets[:-1], sizes - self.item_widths + 1)] = True
        order = suffix_array(self.ids[: len(starts)], 1, window) if len(sizes) else np.zeros(0, np.int64)
        self.place = order[starts[order]].astype(np.int32)
        fresh = np.ones(len(self.place), bool)
        for i in range(1, len(self.place), TOGETHER):
            rows = self.rows(self.place[i - 1 : i + TOGETHER])
            fresh[i : i + TOGETHER] = (rows[1:] != rows[:-1]).any(1)
        self.heads = np.append(np.flatnonzero(fresh), len(self.place)).astype(np.int32)

    def item(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, place, side="right") - 1

    def rows(self, place: np.ndarray) -> np.ndarray:
        """The numbers of the windows there, with zeros behind shorter ones."""
        columns = np.arange(self.window)
        return np.where(columns < self.item_widths[self.item(place)][:, None], self.ids[place[:, None] + columns], 0)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.ids, self.offsets, self.item_widths, self.place, self.heads))


def suffix_array(ids: np.ndarray, least: int, depth: int) -> np.ndarray:
    """Starts of suffixes, in the order of their first ``depth`` numbers.

    Zeros end every suffix.  Runs of fewer than ``least`` numbers are left out:
    nothing that is searched fits into them.  Ranks double in length each round.
    """
    zero = np.flatnonzero(np.concatenate([ids == 0, [True]]))
    stop = np.repeat(zero, np.diff(zero, prepend=-1))[: len(ids)]  # where each position's run ends
    begin = np.concatenate([[0], zero[:-1] + 1])
    long_run = np.repeat(zero - begin >= least, np.diff(zero, prepend=-1))[: len(ids)]
    at = np.flatnonzero(long_run & (ids != 0))
    if not len(at):
        return at
    left, rank, h = stop[at] - at, np.zeros(len(ids) + 1, np.int64), 1
    rank[at] = ids[at]
    order = np.argsort(rank[at], kind="stable")
    while h < depth:
        top = int(rank.max()) + 1
        key = rank[at] * top + np.where(h < left, rank[np.minimum(at + h, len(ids))], 0)
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[1], 1 + np.cumsum(key[order][1:] != key[order][:-1])])
        rank[at[order]] = new
        if new[-1] == len(at):
            break
        h *= 2
    return at[order]


def search(ids: np.ndarray, array: np.ndarray, table: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``table`` (its first ``widths`` numbers): the range of suffixes that begin with it."""
    padded, columns = np.concatenate([ids, np.zeros(table.shape[1], ids.dtype)]), np.arange(table.shape[1])
    inside = columns < widths[:, None]

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(table), np.int64), np.full(len(table), len(array))
        while (open_ := low < high).any():
            middle = (low + high) // 2
            there = np.where(inside, padded[array[np.minimum(middle, len(array) - 1)][:, None] + columns], 0)
            differs = there != table
            first = differs.argmax(1)
            rows = np.arange(len(table))
            less = differs.any(1) & (there[rows, first] < table[rows, first])
            right = open_ & (less | (upper & ~differs.any(1)))
            low = np.where(right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        return low

    return bound(False), bound(True)


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size says."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def shard_hits(texts: list[bytes | None], block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """Words, words hit, and for each document and item that meet the longest match.

    Returns (words of each text, offsets of texts in the shard's numbers, hit
    flags by number, [(text, item, length, word in text, word in item)]).
    """
    known = block.vocabulary.get
    parts = [np.fromiter(map(known, w, repeat(0)), np.int32, len(w)) for w in map(words_of, texts)]
    counts = np.array([len(p) for p in parts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts + 1)])
    ids = np.zeros(offsets[-1] + 1, np.int32)
    for p, at in zip(parts, offsets.tolist(), strict=False):
        ids[at : at + len(p)] = p
    del parts
    hit = np.zeros(len(ids), bool)
    array = suffix_array(ids[:-1], block.least, block.window) if len(block.place) else np.zeros(0, np.int64)
    if not len(array):
        return counts, offsets, hit, []
    cover, best = np.zeros(len(ids) + 1, np.int32), {}
    for i in range(0, len(block.heads) - 1, TOGETHER):
        first = block.place[block.heads[:-1][i : i + TOGETHER]]
        widths = block.item_widths[block.item(first)]
        low, high = search(ids[:-1], array, block.rows(first), widths)
        met = np.flatnonzero(low < high)
        place, which = array[_expand(low[met], (high - low)[met])], np.repeat(met, (high - low)[met])
        np.add.at(cover, place, 1)
        np.add.at(cover, place + widths[which], -1)
        _longest(ids, offsets, place, which + i, block, best)
    hit = np.cumsum(cover[:-1]) > 0
    return counts, offsets, hit, [(t, i, *m) for (t, i), m in best.items()]


def _longest(ids: np.ndarray, offsets: np.ndarray, place: np.ndarray, which: np.ndarray, block: Block, best: dict[tuple[int, int], tuple]) -> None:
    """Put the longest match of each text and item into ``best``, from where windows occur.

    Occurrences meet the places of their window in the items in turns, so that
    memory is bounded however many items share a window; what goes on from a
    match that began a word earlier is left out at once.
    """
    uses = np.diff(block.heads)[which].astype(np.int64)
    done = np.concatenate([[0], np.cumsum(uses)])
    for start in range(0, int(done[-1]), TOGETHER):
        pair = np.arange(start, min(start + TOGETHER, done[-1]))
        at = np.searchsorted(done, pair, side="right") - 1
        p, q = place[at], block.place[block.heads[which[at]] + pair - done[at]].astype(np.int64)
        before = np.where(p > 0, ids[p - 1], 0)
        own = (before == 0) | (q == 0) | (before != block.ids[q - 1])
        p, q = p[own], q[own]
        item, text = block.item(q), np.searchsorted(offsets, p, side="right") - 1
        length = block.item_widths[item].astype(np.int64)
        on = np.arange(len(p))
        while len(on):
            word = ids[p[on] + length[on]]
            on = on[(word != 0) & (word == block.ids[q[on] + length[on]])]
            length[on] += 1
        order = np.lexsort((q, p, -length, item, text))
        text, item, length, p, q = (x[order] for x in (text, item, length, p, q))
        first = np.concatenate([[True], (np.diff(text) != 0) | (np.diff(item) != 0)])[: len(text)]
        for t, i, n, x, y in zip(*(v[first].tolist() for v in (text, item, length, p - offsets[text], q - block.offsets[item])), strict=True):
            if n > best.get((t, i), (0,))[0]:
                best[t, i] = (n, x, y)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """What of each document stands in a benchmark item, by windows of words.

    ASCII capitals become small; words are runs of digits, letters and
    characters beyond ASCII.  A window is ``window`` consecutive words of an
    item, or a shorter item as a whole.  Partitions are read in shards of
    ``SHARD_BYTES``; each shard's suffix array (over the words that the
    benchmark has, of runs long enough to hold a window) is searched for every
    suffix of every item, cut to its window; adjoining windows make the longest
    match.  The benchmark comes to the executors in blocks of at most
    ``BLOCK_BYTES`` (or one item), measured before they are sent, however large
    it is; a block in a worker takes some eight times its text.

    Returns doc_id, n_words, n_hit (words inside any occurrence), items (ids of
    items met, as sorted strings), matches (item_id, length, doc_word,
    item_word: for each the longest match, the first where several are).

    Null texts have no words.  Items without words match nothing; those without
    an id hit words as any other but aren't among ``items`` and ``matches``;
    items that repeat an id count once.  Repeated documents each have their row.
    """
    spark, base = docs.sparkSession, narrowed(docs, id_col, text_col)
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark["text"].cast("string").alias("text")).where("text is not null").distinct()
    blocks = 1
    while True:
        block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
        sizes = items.select(block.alias("block"), F.octet_length("text").alias("size")).groupBy("block").agg(F.sum("size").alias("size"), F.max("size").alias("largest")).collect()
        if all(r["size"] <= max(BLOCK_BYTES, r["largest"]) for r in sizes):
            break
        blocks *= 2
    sent = []
    for k in sorted(r["block"] for r in sizes):
        rows = items.where(block == k).collect()
        sent.append(spark.sparkContext.broadcast(sorted(((r[0], r[1].encode()) for r in rows), key=lambda r: (r[0] is None, r))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Block] = {}

        def block(k: int) -> Block:
            if k in made:
                return made[k]
            if len(made) > 1:
                made.clear()
            return made.setdefault(k, Block(sent[k].value, window))

        def shard(names: list[pa.Array], texts: list[bytes | None]) -> pa.RecordBatch:
            met: list[dict] = [{} for _ in texts]
            flags = None
            for k in range(len(sent)):
                counts, offsets, hit, found = shard_hits(texts, block(k))
                flags = hit if flags is None else flags | hit
                for t, i, n, p, q in found:
                    for name in block(k).names[i]:
                        if name is not None and n > met[t].get(name, (0,))[0]:
                            met[t][name] = (n, p, q)
            if flags is None:
                counts = np.array([len(words_of(t)) for t in texts], np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts + 1)])
                flags = np.zeros(offsets[-1] + 1, bool)
            sums = np.concatenate([[0], np.cumsum(flags)])
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(names),
                    pa.array(counts),
                    pa.array(sums[offsets[1:]] - sums[offsets[:-1]], pa.int64()),
                    pa.array([sorted(m) for m in met], pa.list_(pa.string())),
                    pa.array([[{"item_id": i, "length": n, "doc_word": p, "item_word": q} for i, (n, p, q) in sorted(m.items())] for m in met], matches),
                ],
                ["doc_id", "n_words", "n_hit", "items", "matches"],
            )

        matches = pa.list_(pa.struct([("item_id", pa.string()), ("length", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64())]))
        names, texts, held = [], [], 0
        for b in batches:
            own = utf8(b.column("text"))
            names.append(b.column("doc_id"))
            texts += own
            held += sum(len(t or b"") for t in own)
            if held >= SHARD_BYTES:
                yield shard(names, texts)
                names, texts, held = [], [], 0
        if names:
            yield shard(names, texts)

    return map_arrow(base, scan, [("doc_id", id_type(base)), ("n_words", "long"), ("n_hit", "long"), ("items", "array<string>"), ("matches", "array<struct<item_id:string,length:long,doc_word:long,item_word:long>>")])


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark.

    Rows go through the search as they are; none is looked up by its id.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["text"])
    return benchmark_hits(rows, benchmark, window, "_row").where("n_hit = 0").select("doc_id.*")
