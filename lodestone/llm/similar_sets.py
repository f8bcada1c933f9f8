"""Near copies: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, found by SimHash.

1. Sets.  A text is the set of its shingles' XXH64; equal sets are one node.
2. Fingerprints.  Each lane of 64 bits is a SimHash of the set by another hash.
   Eight lanes (512 bits) are compared: two sets of similarity 0.8 differ in 78
   of these bits in the mean, seldom in over 112.
3. Tries.  A node goes to several binary tries, each with other bits first, and
   meets there the nodes that agree in the first levels.  The number of levels
   grows with the logarithm of the number of nodes, so that a trie's subtree
   stays small; the number of tries grows so that a pair of similarity 0.8
   misses all of them with a probability of ``MISSED`` at most.  A subtree that
   is large all the same, as a large group of copies makes it, is cut some
   levels deeper: its nodes have many neighbours to be linked by, and the pieces
   have candidates with each other.
4. Candidates.  In each subtree, pairs of trie nodes are walked down together
   within an error budget.  Of the leaf pairs within ``NEAR`` bits, nearest first,
   those are candidates that connect all that the pairs connect: not all pairs.
5. Each candidate is verified by the whole sets, and verified pairs are links.
   Then the tries are walked again for pairs that links don't connect and that
   weren't candidates yet, farther ones and more of them, until a turn brings
   less than ``PRODUCTIVE`` of all links.
6. What tries missed.  Sets that are similar share one of the first fifth of
   their hashes, in any order common to all sets; so each node goes to these
   (``prefix``), and pairs of different classes that meet there are candidates,
   whatever their fingerprints.  Sizes and bitmaps of parities refuse those that
   can't be similar, whole sets decide.  After that no link is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.scratch import discard, map_arrow, stored, utf8
from lodestone.llm.simhash import connect, walk

#: The similarity is SHARED / OF.
SHARED, OF = 4, 5
#: Lanes of 64 bits that are compared, and bits on a trie's levels that near copies may differ in.
LANES, NEAR_ON_LEVELS = 8, 16
#: Share of all lanes' bits that candidates may differ in, in the first turns and all later ones: what is
#: nearest is compared first, and what that links needn't be compared again.
NEAR = (0.165, 0.19, 0.219)
#: Probability that a pair of similarity SHARED / OF differs in a bit.
DIFFER = math.acos(2 * SHARED / (SHARED + OF)) / math.pi
#: Probability that such a pair meets in no trie.
MISSED = 0.05
#: Nodes of a subtree in the mean, and at most.
SUBTREE, LARGEST = 2048, 3072


#: Turns end when one brings less than this share of all links.
PRODUCTIVE = 0.001

#: Texts, about, whose shingles are counted so that frequent ones come last in prefixes, and how many of these
#: have a place of their own: that decides how many candidates there are, not which links are found.
COUNTED, FREQUENT = 4096, 1 << 16
#: Least number of bits of a set's parities, and rows or pairs of prefixes that a task holds at once, but for one hash's rows.
PARITIES, TOGETHER = 1024, 1 << 20


def shingles(text: bytes, words_in_shingle: int = 5) -> np.ndarray:
    """The sorted, distinct XXH64 of a text's shingles; words and shingles as in ``simhash.fingerprint``."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - words_in_shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:z], 42) for a, z in zip(starts, ends[-n:].tolist(), strict=True)), np.uint64, n))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= SHARED * (len(a) + len(b) - both)


def lanes(own: np.ndarray, count: int) -> np.ndarray:
    """The set's fingerprint: so many lanes of 64 bits, each bit set if it is in over half the hashes."""
    out = np.zeros(count, ">u8")
    for lane in range(count):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(own), 65536):
            h = own[i : i + 65536] + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[lane] = np.packbits(ones * 2 > len(own)).view(">u8")[0]
    return out


def prefix(own: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The hashes of a set that come first, seldom ones before ``frequent`` ones (sorted, with ``counts``).

    Sets that are similar share ``SHARED / OF`` of the larger one's hashes at
    least, so that the first that they share, in this order, is in the prefixes of both.
    """
    n = len(own) + 1 - -(-SHARED * len(own) // OF)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        own = own[np.argsort(np.where(frequent[at] == own, counts[at], 0), kind="stable")]
    return own[:n]


def parities(own: np.ndarray) -> bytes:
    """A bit for each remainder of the hashes: set if it has an odd number of them; twice as many bits as hashes at least."""
    bits = max(PARITIES, 1 << (2 * len(own) - 1).bit_length() if len(own) else 0)
    odd = np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two sets' parities differ: no more than the sets do.  The longer are folded to the shorter."""
    short, long = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0) ^ short).sum())


def levels_and_tries(n: int) -> tuple[int, int]:
    """First levels on which nodes of a trie must agree, and tries, for ``n`` nodes."""
    levels = max(0, math.ceil(math.log2(max(1, n) / SUBTREE)))
    meet = (1 - DIFFER) ** levels
    return levels, 1 if levels == 0 else math.ceil(math.log(MISSED) / math.log1p(-meet))


def _subtree() -> F.Column:
    """A number for what the nodes of one subtree agree in: ``depth`` bits of the path, and beyond 64 bytes of the whole fingerprint."""
    first = F.expr("CASE WHEN depth = 0 THEN 0L WHEN depth >= 64 THEN path ELSE shiftrightunsigned(path, 64 - depth) END")
    more = F.expr("substring(print, 1, CAST(greatest(0, depth - 57) DIV 8 AS INT))")
    return F.xxhash64("trie", "depth", first, more).alias("subtree")


def _dealt(prints: DataFrame, levels: int) -> tuple[DataFrame, list[DataFrame]]:
    """(trie, depth, subtree, path, node, print): each node's place in each trie, and how deep its subtree's root is.

    Subtrees of over ``LARGEST`` nodes are cut deeper until none is larger.
    Returns also tables of candidates (a, b): of each piece of a subtree that
    was cut its least node, with that of the piece with most nodes.
    """
    deepest, whole, hubs = 64 * (LANES + 1), ["trie", "depth", "subtree"], []
    spread = prints.select("node", "print", F.posexplode("paths").alias("trie", "path"))
    turned = F.expr(f"concat(substring(print, 8 * (trie % {LANES}) + 1), substring(print, 1, 8 * (trie % {LANES})))")
    placed = spread.select("trie", F.lit(levels).alias("depth"), "path", "node", turned.alias("print"))
    dealt = stored(placed.withColumn("subtree", _subtree()), "dealt")
    while True:
        sizes = dealt.groupBy(whole).agg(F.count("*").alias("n")).where((F.col("n") > LARGEST) & (F.col("depth") < deepest))
        # near copies agree in a bit with a probability of 0.85 or more: four levels and more to halve a group of them
        deeper = F.col("depth") + F.ceil(F.log2(F.col("n") / SUBTREE) / -math.log2(1 - DIFFER)).cast("int")
        large = stored(sizes.select(*whole, F.least(deeper, F.lit(deepest)).alias("deeper")), "large-subtrees")
        if large.isEmpty():
            discard(large)
            return dealt, hubs
        moved = dealt.join(large, whole, "left").withColumn("old", F.when(F.col("deeper").isNotNull(), F.struct(*whole)))
        moved = moved.select("trie", F.coalesce("deeper", "depth").alias("depth"), "path", "node", "print", "old")
        after = stored(moved.withColumn("subtree", _subtree()), "dealt")
        pieces = after.where("old IS NOT NULL").groupBy("old", "subtree").agg(F.min("node").alias("b"), F.count("*").alias("n"))
        most = pieces.groupBy("old").agg(F.max_by("b", F.struct("n", "b")).alias("a"))
        hubs.append(stored(pieces.join(most, "old").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "hubs"))
        discard(dealt, large)
        dealt = after


def forest(n: int, x: np.ndarray, y: np.ndarray, d: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of the pairs, sorted by distance, connect all that they connect beyond ``label``; nearest first."""
    chosen, label = [np.zeros(0, np.int64)], label.copy()
    for left, right in _runs(d):
        own = np.arange(left, right)
        while True:
            own = own[label[x[own]] != label[y[own]]]
            if not len(own):
                break
            # each label that isn't the least of its neighbours' is joined to a smaller one by one pair
            _, first = np.unique(np.maximum(label[x[own]], label[y[own]]), return_index=True)
            chosen.append(own[first])
            label = connect(n, x[chosen[-1]], y[chosen[-1]], label)
    return np.concatenate(chosen)


def _runs(*sorted_columns: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal rows."""
    if not len(sorted_columns[0]):
        return []
    new = np.zeros(len(sorted_columns[0]), bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    heads = np.flatnonzero(new)
    return list(zip(heads.tolist(), [*heads[1:].tolist(), len(new)], strict=True))


def _local(label: np.ndarray) -> np.ndarray:
    """Labels as the first place that has them."""
    _, first, at = np.unique(label, return_index=True, return_inverse=True)
    return first[at]


def forests(turn: int) -> int:
    """How often pairs that connect all are taken out in a turn: once for each distance, then twice as often each time."""
    return 1 << max(0, turn - len(NEAR) + 1)


def near_pairs(path: np.ndarray, prints: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, bits that differ) of a subtree's near leaves, sorted by these; ``path`` is sorted."""
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]

    def meet(x: np.ndarray, y: np.ndarray) -> None:
        d = np.bitwise_count(prints[x] ^ prints[y]).sum(1, dtype=np.int64)
        near = d <= NEAR[-1] * 64 * LANES
        found.append((x[near].astype(np.int32), y[near].astype(np.int32), d[near].astype(np.int16)))

    walk(path, min(depth, 64), NEAR_ON_LEVELS, meet)
    x, y, d = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((y, x, d))
    return x[order], y[order], d[order]


def candidates(path: np.ndarray, prints: np.ndarray, depth: int, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a subtree's leaves to verify now; ``history`` has the nodes' labels as of each turn before and now.

    What was a candidate before follows from the labels of then, so that only
    new pairs come out.
    """
    x, y, d = near_pairs(path, prints, depth)
    left = np.arange(len(x))
    for turn, label in enumerate(map(_local, history)):
        new = [np.zeros(0, np.int64)]
        for _ in range(forests(turn)):
            near = left[: np.searchsorted(d[left], NEAR[min(turn, len(NEAR) - 1)] * 64 * LANES, side="right")]
            taken = forest(len(path), x[near], y[near], d[near], label)
            if not len(taken):
                break
            new.append(near[taken])
            left = np.delete(left, taken)
    now = np.concatenate(new)
    return x[now], y[now]


def _met(dealt: DataFrame, turns: int) -> DataFrame:
    """(a, b), a < b: the candidates of turn ``turns``; ``dealt`` has the labels of the turns before as ``label1`` ..."""
    labels = [f"label{i}" for i in range(1, turns)]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got).combine_chunks()
        trie, depth, subtree, path, node, *known = (whole.column(c).to_numpy() for c in columns if c != "print")
        path = path.view(np.uint64)
        prints = np.frombuffer(b"".join(whole.column("print").to_pylist()), ">u8").reshape(-1, LANES).astype(np.uint64)
        order = np.lexsort((node, *prints.T[::-1], path, subtree, depth, trie))
        trie, depth, subtree, path, node, prints, *known = (c[order] for c in (trie, depth, subtree, path, node, prints, *known))
        for a, z in _runs(trie, depth, subtree):
            history = [np.arange(z - a), *(k[a:z] for k in known)]
            if z - a < 2 or (history[-1] == history[-1][0]).all():
                continue
            x, y = candidates(path[a:z], prints[a:z], int(depth[a]), history)
            if len(x):
                one, other = node[a:z][x], node[a:z][y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other))], ["a", "b"])

    columns = ["trie", "depth", "subtree", "path", "node", "print", *labels]
    by_subtree = dealt.select(*columns).repartition("subtree")
    return map_arrow(by_subtree, join, [("a", "long"), ("b", "long")])


def _sets(pairs: DataFrame, numbered: DataFrame, words_in_shingle: int) -> DataFrame:
    """(number, own): the whole sets of the nodes that the (a, b) pairs have."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t or b"", words_in_shingle).tobytes() for t in utf8(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("number"), pa.array(own, pa.binary())], ["number", "own"])

    wanted = pairs.select(F.col("a").alias("number")).unionByName(pairs.select(F.col("b").alias("number"))).distinct()
    return stored(map_arrow(numbered.select("number", "text").join(wanted, "number", "left_semi"), sets, [("number", "long"), ("own", "binary")]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the (a, b) pairs whose whole sets are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)
            keep = pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    there = pairs.join(sets.select(F.col("number").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("number").alias("b"), F.col("own").alias("y")), "b")
    return stored(map_arrow(there.select("a", "b", "x", "y"), compare, [("a", "long"), ("b", "long")]), "verified")


def _frequent(numbered: DataFrame, rows: int, words_in_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes that occur repeatedly in about ``COUNTED`` texts, and how often: ``FREQUENT`` at most."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in utf8(b.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t or b"", words_in_shingle).view(np.int64))], ["hash"])

    some = numbered.where(F.pmod(F.xxhash64("number"), F.lit(max(1, rows // COUNTED))) == 0).select("text")
    counted = map_arrow(some, spread, [("hash", "long")]).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    got = counted.orderBy(F.desc("n"), "hash").limit(FREQUENT).collect()
    hashes, counts = np.array([r["hash"] for r in got], np.int64).view(np.uint64), np.array([r["n"] for r in got], np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def sharing(token: np.ndarray, label: np.ndarray, node: np.ndarray, size: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b), a < b: nodes of different labels that have a token and may be similar; rows are sorted by token and label.

    If the token, at place ``at`` of each set, is the first that both have, the
    sets differ in all hashes before it and have no more in common than one has from
    there on.  Similar sets stand both tests at their first common token.
    """
    other = np.concatenate([token[1:] != token[:-1], [True]])
    ends = np.flatnonzero(other)
    past_token = np.repeat(ends + 1, np.diff(ends, prepend=-1))
    ends = np.flatnonzero(other | np.concatenate([label[1:] != label[:-1], [True]]))
    past_label = np.repeat(ends + 1, np.diff(ends, prepend=-1))
    partners = past_token - past_label
    turns = np.cumsum(partners) // TOGETHER
    for first, past in _runs(turns):
        own = partners[first:past]
        x = np.repeat(np.arange(first, past), own)
        if not len(x):
            continue
        y = past_label[x] + np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own)
        both = size[x] + size[y]
        fit = (OF + SHARED) * (at[x] + at[y]) <= (OF - SHARED) * both
        fit &= (OF + SHARED) * np.minimum(size[x] - at[x], size[y] - at[y]) >= SHARED * both
        a, b = np.minimum(node[x], node[y])[fit], np.maximum(node[x], node[y])[fit]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        heads = [start for start, _ in _runs(a, b)]
        yield a[heads], b[heads]


def _unlinked(rows: DataFrame, named: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of nodes with different labels that prefixes, sizes and parities allow to be similar.

    ``rows`` has each number's prefix, size and parities, ``named`` the label of each node.
    """
    spread_fields = [("token", "long"), ("label", "long"), ("node", "long"), ("size", "int"), ("at", "int")]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("prefix").to_pylist()
            each = np.array([len(r) // 8 for r in raw], np.int64)
            token = np.frombuffer(b"".join(raw), np.int64)
            columns = [pa.array(np.repeat(b.column(c).to_numpy(), each)) for c, _ in spread_fields[1:-1]]
            columns.append(pa.array((np.arange(len(token)) - np.repeat(np.cumsum(each) - each, each)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(token), *columns], [c for c, _ in spread_fields])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, enough = [], 0, TOGETHER

        def pairs(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, enough
            columns = [np.concatenate([h[i] for h in held]) for i in range(len(spread_fields))]
            token = columns[0]
            cut = len(token) if last else int(np.searchsorted(token, token[-1]))  # the last token may go on
            for a, b in sharing(*(c[:cut].astype(np.int64) for c in columns)):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            held, size = [[c[cut:] for c in columns]], len(token) - cut
            enough = max(TOGETHER, 2 * size)

        for b in batches:
            held.append([b.column(c).to_numpy() for c, _ in spread_fields])
            size += b.num_rows
            if size >= enough:
                yield from pairs(last=False)
        if size:
            yield from pairs(last=True)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            differ = np.fromiter(map(differing, b.column("x").to_pylist(), b.column("y").to_pylist()), np.int64, b.num_rows)
            keep = pa.array((OF + SHARED) * differ <= (OF - SHARED) * b.column("sizes").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    ends = [("a", "long"), ("b", "long")]
    there = rows.withColumnRenamed("number", "node").join(named, "node").select("label", "node", "size", "prefix")
    by_token = map_arrow(there, spread, spread_fields).repartition("token").sortWithinPartitions("token", "label")
    pairs = stored(map_arrow(by_token, meet, ends).distinct(), "sharing")
    known = [rows.select(F.col("number").alias(c), F.col("parities").alias(p), F.col("size").alias(f"size_{c}")) for c, p in (("a", "x"), ("b", "y"))]
    both = pairs.join(known[0], "a").join(known[1], "b").select("a", "b", "x", "y", (F.col("size_a").cast("long") + F.col("size_b")).alias("sizes"))
    out = stored(map_arrow(both, screen, ends), "unlinked")
    discard(pairs)
    return out


def _joined(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(node, label): each node's label after links (a, b) have joined classes, the least of theirs.

    Only the links' classes are brought together, not all links so far again.
    """
    if labels is None:
        return components(links)
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    known = labels.unionByName(ends.distinct().join(labels, "node", "left_anti").withColumn("label", F.col("node")))
    of = [known.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")) for c in "ab"]
    between = links.join(of[0], "a").join(of[1], "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    met = components(between).select(F.col("node").alias("label"), F.col("label").alias("least"))
    out = stored(known.join(met, "label", "left").select("node", F.coalesce("least", "label").alias("label")), "joined")
    discard(met)
    return out


def similar_classes(numbered: DataFrame, words_in_shingle: int = 5) -> DataFrame:
    """(number, class): classes of (number, text) rows that links of similar or equal sets connect.

    ``numbered`` is read several times and its numbers are distinct.  The class
    is the smallest number in it.  Null, empty and white texts have the empty
    set and are one class; a text of fewer words than a shingle has is one
    shingle.  No rows: no rows.  Tries find a pair of similarity 0.8 with a
    probability of about 0.94 (``MISSED``, and ``NEAR`` bits); prefixes find
    every pair that tries' links don't connect.  No link is of sets less similar.
    """
    n = numbered.count()
    levels, tries = levels_and_tries(n)
    frequent, counts = _frequent(numbered, n, words_in_shingle)
    count = max(LANES, -(-max(levels * tries, 64) // 64))
    at = (np.arange(tries)[:, None] * levels + np.arange(64)[None, :]) % (64 * count)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t or b"", words_in_shingle) for t in utf8(b.column("text"))]
            marks = [lanes(s, count) for s in own]
            paths = [np.packbits(np.unpackbits(m.view(np.uint8))[at], axis=1).view(">u8").ravel().astype(np.int64) for m in marks]
            columns = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary()), pa.array([m[:LANES].tobytes() for m in marks], pa.binary()), pa.array(paths, pa.list_(pa.int64()))]
            columns += [pa.array([len(s) for s in own], pa.int32()), pa.array([prefix(s, frequent, counts).tobytes() for s in own], pa.binary()), pa.array([parities(s) for s in own], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("number"), *columns], [c for c, _ in fields])

    fields = [("number", "long"), ("digest", "binary"), ("print", "binary"), ("paths", "array<long>"), ("size", "int"), ("prefix", "binary"), ("parities", "binary")]
    rows = stored(map_arrow(numbered.select("number", "text"), scan, fields), "prints")
    nodes = stored(rows.groupBy("digest").agg(F.min("number").alias("node")), "nodes")
    heads = rows.join(nodes.select(F.col("node").alias("number")), "number", "left_semi").select(F.col("number").alias("node"), "print", "paths")
    # sets with equal fingerprints are linked through the first of them, which alone goes to the tries
    leads = stored(heads.groupBy("print").agg(F.min("node").alias("lead")), "leads")
    same = stored(heads.join(leads, "print").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")), "same")
    dealt, hubs = _dealt(heads.join(leads.select(F.col("lead").alias("node")), "node", "left_semi"), levels)
    turn, all_links, labels, sets = 1, 0, None, None
    while True:
        pairs = _met(dealt, turn)
        for more in [same, *hubs] if turn == 1 else []:
            pairs = pairs.unionByName(more)
        pairs = stored(pairs.distinct(), "pairs")
        if turn == 1:  # a node without a candidate has none later
            sets = _sets(pairs, numbered, words_in_shingle)
        found = _verified(pairs, sets)
        new = found.count()
        all_links += new
        before, labels = labels, _joined(found, labels)
        discard(pairs, found, *([] if before is None else [before]))
        if turn >= len(NEAR) and new <= PRODUCTIVE * all_links:
            break
        active = dealt.join(sets.select(F.col("number").alias("node")), "node", "left_semi") if turn == 1 else dealt
        named = active.join(labels, "node", "left").withColumn(f"label{turn}", F.coalesce("label", "node")).drop("label")
        was, dealt = dealt, stored(named, "dealt")
        discard(was)
        turn += 1
    discard(dealt, leads, same, sets, *hubs)
    named = nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    missed = _unlinked(rows, named)
    sets = _sets(missed, numbered, words_in_shingle)
    found = _verified(missed, sets)
    if not found.isEmpty():
        before, labels = labels, _joined(found, labels)
        discard(before)
    discard(missed, sets, found)
    classes = rows.select("number", "digest").join(nodes, "digest")
    return classes.join(labels, "node", "left").select("number", F.coalesce("label", "node").alias("class"))
