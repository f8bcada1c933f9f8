"""Near-duplicates by SimHash fingerprints and a binary-trie self-join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.scratch import discard, id_type, map_arrow, narrowed, stored, utf8

#: Node pairs with no more leaf pairs than this are compared leaf by leaf.
LEAVES = 64
#: Node pairs, or leaf pairs, that a task holds at once.
FRONTIER = 500_000
#: Keys of one trie; one that has more is split into several, if the keys that
#: these have together are at most so many times as many in the mean.
TRIE_KEYS, LEAST_GAIN = 4096, 0.75


def fingerprint(text: bytes, words_in_shingle: int = 4) -> int:
    """64 bits: each set if it is set in over half the shingles' XXH64.

    ASCII capitals become small, words are what ASCII white space separates;
    fewer words than a shingle has make one shingle, none make 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - words_in_shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:z], 42) for a, z in zip(starts, ends, strict=True)), "<u8", n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        counts += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_in_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bits): every text's fingerprint as a signed 64-bit integer; null texts have 0."""
    base = narrowed(docs, id_col, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.array([fingerprint(t or b"", words_in_shingle) for t in utf8(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "bits"])

    return map_arrow(base, scan, [("doc_id", id_type(base)), ("bits", "long")])


def connect(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index that each of 0..n-1 reaches by links a-b (and by ``label``)."""
    label = np.arange(n) if label is None else label
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label != (deeper := label[label])).any():
            label = deeper


def walk(keys: np.ndarray, fixed: int, errors: int, meet: Callable[[np.ndarray, np.ndarray], None], done: Callable[..., np.ndarray] | None = None) -> None:
    """Walk a binary trie's pairs of nodes down together, from nodes of ``fixed`` bits.

    ``keys`` are its leaves, sorted.  A pair goes when the bits in which its
    nodes' paths differ exceed ``errors``, or when ``done`` (of the four ends
    of the nodes' ranges of leaves) says so.  ``meet`` gets the leaves, as
    places x < y, that differ in at most ``errors`` bits.
    """
    n = len(keys)
    if n < 2:
        return
    roots = keys >> np.uint64(64 - fixed) if fixed else np.zeros(n, np.uint64)
    heads = np.flatnonzero(np.concatenate([[True], roots[1:] != roots[:-1]]))
    tails = np.append(heads[1:], n)
    big = tails - heads > 1
    heads, tails = heads[big], tails[big]
    stack = [(fixed, heads, tails, heads, tails, np.zeros(len(heads), np.int64))]
    while stack:
        depth, a0, a1, b0, b1, diff = stack.pop()
        if done:
            keep = ~done(a0, a1, b0, b1)
            a0, a1, b0, b1, diff = (x[keep] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(depth, a0[:half], a1[:half], b0[:half], b1[:half], diff[:half]), (depth, a0[half:], a1[half:], b0[half:], b1[half:], diff[half:])]
            continue
        small = ((a1 - a0) * (b1 - b0) <= LEAVES) | (depth == 64)
        if small.any():
            _leaves(keys, errors, meet, a0[small], a1[small], b0[small], b1[small])
            a0, a1, b0, b1, diff = (x[~small] for x in (a0, a1, b0, b1, diff))
            if not len(a0):
                continue
        bit = np.uint64(1 << (63 - depth))
        low = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
        am = np.clip(np.searchsorted(keys, (keys[a0] & low) | bit), a0, a1)
        bm = np.clip(np.searchsorted(keys, (keys[b0] & low) | bit), b0, b1)
        own = (a0 == b0) & (a1 == b1)
        parts = [(a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1)]
        parts.append(tuple(x[~own] for x in (am, a1, b0, bm, diff + 1)))
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (a0 < a1) & (b0 < b1) & (diff <= errors) & ~((a0 == b0) & (a1 - a0 == 1) & (b1 - b0 == 1))
        stack.append((depth + 1, *(x[keep] for x in (a0, a1, b0, b1, diff))))


def _leaves(keys: np.ndarray, errors: int, meet: Callable[[np.ndarray, np.ndarray], None], a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> None:
    sizes = (a1 - a0) * (b1 - b0)
    turns = np.cumsum(sizes) // FRONTIER
    cuts = np.flatnonzero(np.concatenate([[True], turns[1:] != turns[:-1]]))
    for i, z in zip(cuts, np.append(cuts[1:], len(sizes)), strict=True):
        own = sizes[i:z]
        k = np.repeat(np.arange(i, z), own)
        within = np.arange(len(k)) - np.repeat(np.cumsum(own) - own, own)
        width = (b1 - b0)[k]
        x, y = a0[k] + within // width, b0[k] + within % width
        near = (x < y) & (np.bitwise_count(keys[x] ^ keys[y]) <= errors)
        if near.any():
            meet(x[near], y[near])


def trie_links(keys: np.ndarray, fixed: int, budget: int) -> np.ndarray:
    """Labels of sorted, distinct keys: equal for keys that links connect.

    Keys link if their first ``fixed`` bits are equal and at most ``budget`` of
    the others differ.  Pairs of nodes whose leaves are all connected already
    aren't walked, and nearest pairs are linked first (one differing bit, then
    all), so that dense groups of copies are walked only until connected.
    """
    label = np.arange(len(keys))
    changes = label

    def meet(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal label, changes
        if (label[x] != label[y]).any():
            label = connect(len(keys), x, y, label)
            changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])

    def done(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        return (label[a0] == label[b0]) & (changes[a0] == changes[a1 - 1]) & (changes[b0] == changes[b1 - 1])

    for errors in sorted({min(1, budget), budget}):
        walk(keys, fixed, errors, meet, done)
    return label


def _choices(budget: int, n: int) -> list[tuple[int, ...]]:
    """The choices of blocks of the bits; keys that agree in the blocks of one share a trie.

    With ``budget`` errors in ``budget + spare`` blocks, some ``spare`` of them
    agree; more blocks agree the more keys there are, so that the number of
    keys below one fixed prefix stays bounded as the corpus grows.
    """
    from itertools import combinations

    spare = 1
    while n > 64 << (64 * spare // (budget + spare)) and spare < 4:
        spare += 1
    return list(combinations(range(budget + spare), spare))


def _orders(ones: np.ndarray, n: int, fixed: int, parts: int) -> list[np.ndarray] | None:
    """Orders of a trie's levels behind the first ``fixed``, each with another of so many blocks of bits first.

    Bits are dealt to the blocks by how evenly they are set (``ones`` of ``n``
    keys), so that each block tells keys apart.  None if agreeing in a block
    would leave most keys together: splitting brings nothing then.
    """
    share = ones[fixed:] / n
    even = fixed + np.argsort(-np.minimum(share, 1 - share), kind="stable")
    blocks = [np.sort(even[j::parts]) for j in range(parts)]
    agree = 1 - 2 * (ones / n) * (1 - ones / n)
    if sum(agree[block].prod() for block in blocks) > LEAST_GAIN:
        return None
    rest = np.arange(fixed, 64)
    return [np.concatenate([np.arange(fixed), block, rest[~np.isin(rest, block)]]) for block in blocks]


def _in_order(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The words' bits (from the top) in another order."""
    bits = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(">u8").ravel().astype(np.uint64)


_DEALT = [("bits", "long"), ("word", "long"), ("trie", "long"), ("fixed", "int"), ("prefix", "long")]
_AT = ["trie", "fixed", "prefix"]


def _rows(bits: np.ndarray, word: np.ndarray, trie: np.ndarray, fixed: int) -> pa.RecordBatch:
    prefix = word >> np.uint64(64 - fixed)
    columns = [pa.array(x.view(np.int64)) for x in (bits, word, trie)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(bits), fixed, np.int32)), pa.array(prefix.view(np.int64))], [n for n, _ in _DEALT])


def _dealt(keys: DataFrame, budget: int) -> tuple[DataFrame, list[DataFrame]]:
    """The tries that each key goes to, and its ``word``: its bits in the order of that trie's levels.

    The keys of one trie agree in the word's first ``fixed`` bits, the prefix.
    One of over ``TRIE_KEYS`` keys is dealt again by its other bits: of
    ``budget + 1`` blocks of these, one at least agrees in any two keys that
    link.  So it goes on while that tells keys apart, however alike many are.
    Returns also what was written on the way, to be deleted after use.
    """
    choices, parts = _choices(budget, keys.count()), budget + 1
    edges = [round(64 * i / (1 + max(c[-1] for c in choices))) for i in range(2 + max(c[-1] for c in choices))]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = b.column("bits").to_numpy().view(np.uint64)
            for k, choice in enumerate(choices):
                head = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in choice])
                order = np.concatenate([head, np.setdiff1d(np.arange(64), head)])
                yield _rows(bits, _in_order(bits, order), np.full(len(bits), k, np.uint64), len(head))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                orders = _orders(np.array([r[f"ones{i}"] for i in range(64)]), r["n"], r["fixed"], parts)
                if orders:
                    columns = [pa.array([r[c]], t) for c, t in zip(_AT, (pa.int64(), pa.int32(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([np.concatenate(orders).tolist()], pa.list_(pa.int32()))], [*_AT, "orders"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits, word, trie, fixed, prefix = (b.column(c).to_numpy() for c, _ in _DEALT)
            at = np.lexsort((prefix, trie))
            cuts = np.flatnonzero(np.concatenate([[True], (trie[at][1:] != trie[at][:-1]) | (prefix[at][1:] != prefix[at][:-1])]))
            for own in np.split(at, cuts[1:]) if len(at) else []:
                f, orders = int(fixed[own[0]]), b.column("orders")[int(own[0])].values.to_numpy().reshape(parts, 64)
                for j, order in enumerate(orders):
                    sub = trie[own].view(np.uint64) * np.uint64(parts + 1) + np.uint64(j + 1 + len(choices))
                    yield _rows(bits[own].view(np.uint64), _in_order(word[own].view(np.uint64), order), sub, f + len(range(j, 64 - f, parts)))

    fields = [n for n, _ in _DEALT]
    out, dealt, written = None, map_arrow(keys, first, _DEALT), []
    while True:
        large = dealt.groupBy(_AT).count().where(F.col("count") > TRIE_KEYS).select(_AT)
        ones = [F.sum(F.shiftrightunsigned("word", 63 - i).bitwiseAND(1)).alias(f"ones{i}") for i in range(64)]
        sums = dealt.join(large, _AT, "left_semi").groupBy(_AT).agg(F.count("*").alias("n"), *ones)
        split = stored(map_arrow(sums, plan, [(n, t) for n, t in _DEALT if n in _AT] + [("orders", "array<int>")]).select(*_AT, "orders"), "large-tries")
        written.append(split)
        if split.isEmpty():
            return dealt if out is None else out.unionByName(dealt), written
        fits = dealt.join(split, _AT, "left_anti").select(fields)
        out = fits if out is None else out.unionByName(fits)
        dealt = map_arrow(dealt.join(split, _AT).select(*fields, "orders"), again, _DEALT)


def near_links(bits: DataFrame, budget: int = 4) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within ``budget`` bits.

    Each fingerprint goes, for each choice of blocks of its bits, to the trie
    of the fingerprints that agree in these blocks; each pair within the budget
    meets in one trie at least.  A trie gives each of its keys one link to the
    smallest connected with it, not all pairs.
    """
    keys = stored(bits.select("bits").distinct(), "keys")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(c).to_numpy() for c in ("trie", "fixed", "word", "bits")] for b in batches]
        if not got:
            return
        trie, fixed, word, own = (np.concatenate(x) for x in zip(*got, strict=True))
        word = word.view(np.uint64)
        order = np.lexsort((word, trie))
        cuts = np.flatnonzero(np.concatenate([[True], trie[order][1:] != trie[order][:-1]]))
        for places in np.split(order, cuts[1:]):
            label = trie_links(word[places], int(fixed[places[0]]), budget)
            linked = np.flatnonzero(label != np.arange(len(label)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(own[places[linked]]), pa.array(own[places[label[linked]]])], ["a", "b"])

    dealt, written = _dealt(keys, budget)
    by_trie = dealt.repartition("trie", "prefix").select("trie", "fixed", "word", "bits")
    links = stored(map_arrow(by_trie, join, [("a", "long"), ("b", "long")]), "near-links")
    discard(keys, *written)
    return links


def near_duplicates(docs: DataFrame, budget: int = 4, words_in_shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents whose fingerprints differ in at most ``budget`` bits.

    Returns a row for each document: doc_id, fingerprint (16 hex digits),
    component_id (the smallest doc_id that links reach, itself included).

    Null, empty and white texts have fingerprint zero and are linked like any
    other, so they are one class.  A very long text's hashes are counted in
    pieces; no length changes the rule.  Equal fingerprints are one node, so that
    exact copies add no links.  Rows that repeat an id each have their row; an
    id that is null can't be a class's smallest, unless the class has no other.
    """
    bits = stored(fingerprints(docs, words_in_shingle, id_col, text_col), "fingerprints")
    nodes = bits.groupBy("bits").agg(F.min("doc_id").alias("least_id"))
    links = near_links(bits, budget)
    labels = components(links)
    discard(links)
    linked = stored(nodes.join(labels.withColumnRenamed("node", "bits"), "bits"), "linked")
    least = linked.groupBy("label").agg(F.min("least_id").alias("class_id"))
    classes = linked.join(least, "label").select("bits", "class_id")
    # written, so that nothing but the join stands on the shuffle below, and a fingerprint of very many documents can be split there
    named = stored(nodes.join(classes, "bits", "left").select("bits", F.coalesce("class_id", "least_id").alias("component_id")), "classes")
    discard(linked, labels)
    return bits.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
