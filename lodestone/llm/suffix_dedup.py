"""Repeated byte strings across documents, removed by a suffix order of the corpus.

1. Scan.  Each window of 200 bytes is named by the smallest hash of its 32-byte
   strings, so that equal windows have equal names.  Neighbouring windows of one
   name make a run; a run whose name occurs once in the corpus holds no repeat.
2. Names.  Runs are grouped by name.  A run whose content occurs twice is
   repeated as a whole; runs of one name with different contents are open.
3. Collection.  The open runs' bytes are ordered by column-wise construction of
   the collection's Burrows-Wheeler transform: each round inserts one symbol of
   every sequence, in front of its suffix, and updates the longest common
   prefixes next to it.  A symbol is eight bytes and each run comes in its eight
   shifts, so that a window is 25 symbols, at any byte.  Windows that share 25
   symbols with a neighbour in suffix order are repeated.
   A name with more open contents than one collection takes (a passage that a
   large part of all documents holds, each time in another context) isn't
   brought to one task: its windows' 128-bit hashes are dealt out by their
   values and counted.  What a task has several of is combined first, so that a
   window costs the task that counts it a row from each task at most.
4. Removal.  Bytes under repeated windows go from each text.

Whole documents can't be columns (a round for every byte of the longest, each
over the whole corpus); runs are at most 455 bytes, which bounds the rounds, and
no repeat is lost, as all windows of one content are runs of one name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import discard, map_arrow, stored, utf8

#: Bytes of a window, and of the strings whose hashes name it.
WINDOW, GRAM = 200, 32
#: Bytes of a symbol; a window is a whole number of them.
SYMBOL = 8
#: Windows in a run at most; longer runs (repetitive text) are cut.
RUN_WINDOWS = 256
#: Bytes of text scanned together, runs grouped before they leave a task, segments of one collection.
SCAN_BYTES, TASK_RUNS, COLLECTION = 256_000, 1_000_000, 600
#: Open contents of a name above which its windows are dealt out by their hashes (what one collection takes),
#: windows of such names that a task holds at once and in the mean counts, and parts of that deal at least.
HOT_CONTENTS, HELD_WINDOWS, PARTS = COLLECTION, 500_000, 256

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) | np.uint64(1)

# States of a run
LONE, WHOLE, OPEN, PARTNER = 0, 1, 2, 3  # once here; repeated as a whole; to be ordered; repeated, and to be ordered against


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(name, content hash, text, start, windows, whether it can repeat itself) of every run of the texts.

    A run repeats itself only if the string that names it is in it twice.
    """
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    n, has = len(data), ends - begins >= WINDOW
    if not has.any():
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, bool))
    value = _BYTE[data]
    h, width = value, 1
    while width < GRAM:
        h = h[:-width] * np.uint64(pow(_BASE, width, 2**64)) + h[width:]
        width *= 2
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    gram = h
    grams, width = WINDOW - GRAM + 1, 1
    while 2 * width <= grams:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    name = np.minimum(h[: n - WINDOW + 1], h[grams - width :])
    first, past = begins[has], ends[has] - WINDOW + 1
    inside = np.zeros(len(name) + 1, np.int8)
    np.add.at(inside, first, 1)
    np.add.at(inside, past, -1)
    head = np.concatenate([[True], name[1:] != name[:-1]])
    head[first] = True
    head[past[past < len(name)]] = True
    head = np.flatnonzero(head)
    size = np.diff(np.append(head, len(name)))
    valid = np.cumsum(inside) > 0
    live = valid[head]
    head, size = head[live], size[live]
    pieces = -(-size // RUN_WINDOWS)
    which = np.repeat(np.arange(len(head)), pieces)
    step = (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * RUN_WINDOWS
    head, size = head[which] + step, np.minimum(size[which] - step, RUN_WINDOWS)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _powers(_BASE, n))])
    content = (sums[head + size - 1 + WINDOW] - sums[head]) * _powers(pow(_BASE, -1, 2**64), n)[head]
    text = np.searchsorted(ends, head, side="right")
    # strings that are the smallest of some window: those that equal the largest name of the windows around them
    h, width = np.concatenate([np.zeros(grams - 1, np.uint64), np.where(valid[:-1], name, np.uint64(0)), np.zeros(grams - 1, np.uint64)]), 1
    while 2 * width <= grams:
        h = np.maximum(h[:-width], h[width:])
        width *= 2
    smallest = np.flatnonzero(gram == np.maximum(h[: len(gram)], h[grams - width :]))
    low, high = np.searchsorted(smallest, head), np.searchsorted(smallest, head + size - 1 + grams)
    which = np.repeat(np.arange(len(head)), high - low)
    near = smallest[np.arange(len(which)) - np.repeat(np.cumsum(high - low) - high, high - low)]
    twice = np.bincount(which[gram[near] == name[head][which]], minlength=len(head)) > 1
    return name[head], content, text, head - begins[text], size, twice


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """An order by ``keys``, and for each key the group of equal (first to that) keys, in that order."""
    order = np.lexsort(keys[::-1])
    new, out = np.zeros(len(order), bool), []
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
        out.append(np.cumsum(new) - 1)
    return order, out


def _settle(name: np.ndarray, content: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, states) after runs of one name have met."""
    order, (by_name, by_content) = _groups(name, content)
    state = state[order].copy()
    first = np.concatenate([[True], by_content[1:] != by_content[:-1]])[: len(order)]
    times = np.bincount(by_content)[by_content] if len(order) else by_content
    kinds = np.bincount(by_name[first])[by_name] if len(order) else by_name
    several = kinds > 1
    state[((state == LONE) | (state == OPEN)) & (times > 1)] = WHOLE
    state[(state == LONE) & several] = OPEN
    state[(state == WHOLE) & several & first] = PARTNER
    return order, state


_RUN = [("route", "long"), ("named", "boolean"), ("name", "long"), ("content", "long"), ("key", "long"), ("size", "int"), ("start", "int"), ("windows", "int"), ("state", "int")]


def _run_batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = {"long": np.int64, "int": np.int32, "boolean": bool}
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(kinds[t])) for c, (_, t) in zip(columns, _RUN, strict=True)], [f[0] for f in _RUN])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each text; those of one name meet here first, so that few of them go on to meet all others.

    Of the runs of a name that this task has, one goes on by its name for each
    of two contents at most; what the others are is known by then.
    """
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        name, content, key, size, start, windows, twice = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order, state = _settle(name, content, np.where(twice, OPEN, LONE))
        name, content, key, size, start, windows = (x[order] for x in (name, content, key, size, start, windows))
        new_name = np.concatenate([[True], name[1:] != name[:-1]])
        new_content = new_name | np.concatenate([[True], content[1:] != content[:-1]])
        ordinal = np.cumsum(new_content)
        ordinal = ordinal - ordinal[np.flatnonzero(new_name)][np.cumsum(new_name) - 1]
        named = new_content & (ordinal < 2)
        elsewhere = (key ^ start * 0x9E3779B1) | 1
        route = np.where(named, name.view(np.int64), elsewhere)
        for i in range(0, len(name), 100_000):
            s = slice(i, i + 100_000)
            yield _run_batch([c[s] for c in (route, named, name, content, key, size, start, windows, state)])

    for b in batches:
        keys, texts = b.column("key").to_numpy(), utf8(b.column("text"))
        at = 0
        while at < len(texts):
            stop, total = at, 0
            while stop < len(texts) and (total < SCAN_BYTES):
                total += len(texts[stop])
                stop += 1
            name, content, text, start, windows, twice = runs(texts[at:stop])
            sizes = np.array([len(t) for t in texts[at:stop]], np.int64)
            held.append((name, content, keys[at:stop][text], sizes[text], start, windows, twice))
            at = stop
        if sum(len(x[0]) for x in held) > TASK_RUNS:
            yield from flush()
    if held:
        yield from flush()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that came by name are settled; names that occur once go."""
    got: list[list[np.ndarray]] = []
    for b in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        named = columns[1]
        if not named.all():
            yield _run_batch([c[~named] for c in columns])
        got.append([c[named] for c in columns])
    if not got:
        return
    columns = [np.concatenate(x) for x in zip(*got, strict=True)]
    order, state = _settle(columns[2], columns[3], columns[8])
    columns = [c[order] for c in columns[:8]] + [state]
    kept = state != LONE
    for i in range(0, len(order), 100_000):
        yield _run_batch([c[i : i + 100_000][kept[i : i + 100_000]] for c in columns])


def repeated_windows(segments: list[bytes]) -> list[np.ndarray]:
    """For each of distinct segments, whether each of its windows also starts elsewhere in them.

    The collection is every segment in its eight shifts, in symbols of eight
    bytes.  ``text`` and ``length`` name the suffixes in their order, ``before``
    is the transform (the symbol before each), ``shared`` the symbols that each
    shares with the one above.  Ordering the transform by symbol, stably, gives
    each suffix's place after the round; suffixes that were there keep their
    order and their common prefixes, and only next to new ones is a minimum
    taken anew over what lies between the two suffixes behind them.
    """
    shifts = [s[r : r + (len(s) - r) // SYMBOL * SYMBOL] for s in segments for r in range(SYMBOL)]
    symbols = np.frombuffer(b"".join(shifts), "<u8")
    lengths = np.array([len(s) // SYMBOL for s in shifts], np.int64)
    ends = np.cumsum(lengths)
    rank = _ranks(symbols)
    none = int(rank.max()) + 1  # stands before complete texts, after all symbols
    small = none < 65536
    rank = rank.astype(np.uint16 if small else np.uint32)
    count = len(shifts)
    text, length = np.arange(count, dtype=np.int32), np.zeros(count, np.uint8)
    before, shared, newest = rank[ends - 1], np.zeros(count, np.uint8), np.ones(count, bool)
    for done in range(1, int(lengths.max()) + 1):
        order = _by_symbol(before, small)[: len(before) - int((before == none).sum())]
        fresh = newest[order]
        place = np.flatnonzero(fresh) + count
        total = count + len(order)
        old = np.ones(total, bool)
        old[place] = False
        into = text[order[place - count]]
        text, length, grown = _merged(text, old, into), _merged(length, old, done), _merged(shared, old, 0)
        nearby = _sorted_union(place, total)
        nearby = nearby[nearby > count]
        here, above = order[nearby - count], order[nearby - count - 1]
        same = before[here] == before[above]
        grown[nearby] = 0
        nearby, low, high = nearby[same], above[same] + 1, here[same] + 1
        if len(nearby):
            by = np.argsort(low, kind="stable")
            bounds = np.stack([low[by], high[by]], 1).ravel()
            grown[nearby[by]] = 1 + np.minimum.reduceat(np.append(shared, np.uint8(0)), bounds)[::2]
        left = lengths[into] > done
        ahead = np.full(len(into), none, rank.dtype)
        ahead[left] = rank[ends[into[left]] - 1 - done]
        before, shared = _merged(before, old, ahead), grown
        newest = ~old
    whole = WINDOW // SYMBOL
    met = shared >= whole
    met[:-1] |= met[1:].copy()
    at = np.flatnonzero(met & (length >= whole))
    starts = text[at] % SYMBOL + SYMBOL * (lengths[text[at]] - length[at])
    out = [np.zeros(max(0, len(s) - WINDOW + 1), bool) for s in segments]
    offsets = np.cumsum([0, *map(len, out)])
    flat = np.zeros(offsets[-1], bool)
    flat[offsets[text[at] // SYMBOL] + starts] = True
    return [flat[a:z] for a, z in zip(offsets, offsets[1:], strict=False)]


def _merged(values: np.ndarray, old: np.ndarray, new: np.ndarray | int) -> np.ndarray:
    out = np.empty(len(old), values.dtype)
    out[old] = values
    out[~old] = new
    return out


def _sorted_union(place: np.ndarray, total: int) -> np.ndarray:
    """The places and those after them, each once."""
    mark = np.zeros(total + 1, bool)
    mark[place] = True
    mark[place + 1] = True
    return np.flatnonzero(mark[:total])


def _ranks(symbols: np.ndarray) -> np.ndarray:
    order = np.argsort(symbols, kind="stable")
    out = np.empty(len(symbols), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], symbols[order][1:] != symbols[order][:-1]]))
    return out


def _by_symbol(before: np.ndarray, small: bool) -> np.ndarray:
    """A stable order by symbol: radix sort of 16 bits, once or twice."""
    if small:
        return np.argsort(before, kind="stable")
    order = np.argsort((before & np.uint32(65535)).astype(np.uint16), kind="stable")
    return order[np.argsort((before >> np.uint32(16)).astype(np.uint16)[order], kind="stable")]


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of each run of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(z - a)) for a, z in zip(edges[::2], edges[1::2], strict=True)]


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of open runs, those of a name together, to the windows that are repeated."""
    rows: list[dict] = []
    for b in batches:
        rows += b.to_pylist()
    rows.sort(key=lambda r: (r["name"], r["content"]))
    out: list[tuple] = []

    def collection(part: list[list[dict]]) -> None:
        for group, flags in zip(part, repeated_windows([g[0]["bytes"] for g in part]), strict=True):
            spans = [(0, len(flags))] if len(group) > 1 or group[0]["copies"] > 1 else _spans(flags)
            out.extend((r["key"], r["size"], r["start"] + a, n) for r in group if r["state"] == OPEN for a, n in spans)

    part, last = [], None
    for r in rows:
        if part and (r["name"], r["bytes"]) == (last, part[-1][0]["bytes"]):
            part[-1].append(r)
            continue
        if len(part) >= COLLECTION and r["name"] != last:
            collection(part)
            part = []
        part.append([r])
        last = r["name"]
    if part:
        collection(part)
    for i in range(0, len(out), 50_000):
        key, size, start, windows = zip(*out[i : i + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(size, pa.int32()), pa.array(start, pa.int32()), pa.array(windows, pa.int32())], ["key", "size", "start", "windows"])


_WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("key", "<i8"), ("size", "<i4"), ("start", "<i4"), ("copies", "<i8")])


def window_hashes(segment: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each window of a segment."""
    value, out = _BYTE[np.frombuffer(segment, np.uint8)], []
    for base, turn in ((_BASE, 29), (0xD1B54A32D192ED03, 31)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((value ^ (value >> np.uint64(turn))) * _powers(base, len(value)))])
        h = (sums[WINDOW:] - sums[:-WINDOW]) * _powers(pow(base, -1, 2**64), len(value))[: len(value) - WINDOW + 1]
        h = (h ^ (h >> np.uint64(turn))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(h ^ (h >> np.uint64(32)))
    return out[0], out[1]


def _dealt(windows: np.ndarray, part: np.ndarray, known: bool) -> Iterator[pa.RecordBatch]:
    """Windows in one blob for each part; none of no windows."""
    if not len(windows):
        return
    order = np.argsort(part, kind="stable")
    windows, part = windows[order], part[order]
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))[: len(part)]
    for a, z in zip(heads, np.append(heads[1:], len(part)), strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int32()), pa.array([known], pa.bool_()), pa.array([windows[a:z].tobytes()], pa.binary())], ["part", "known", "windows"])


def _new(windows: np.ndarray) -> np.ndarray:
    """Whether each of the sorted windows differs from the one before."""
    return np.concatenate([[True], (windows["a"][1:] != windows["a"][:-1]) | (windows["b"][1:] != windows["b"][:-1])])[: len(windows)]


def _windows(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """All windows of the hot names' segments, dealt out by their first hash.

    Those that this task has several of are known to be repeated, and go on by
    their texts (``known``); one that stands for them, of size 0, tells others.
    """

    def flush() -> Iterator[pa.RecordBatch]:
        windows = np.concatenate(held)
        windows = windows[np.lexsort((windows["b"], windows["a"]))]
        new = _new(windows)
        group = np.cumsum(new) - 1
        several = np.bincount(group, windows["copies"])[group] > 1
        told = windows[new & several]
        told["size"], told["copies"] = 0, 2
        yield from _dealt(windows[several], windows["key"][several] % parts, known=True)
        asked = np.concatenate([windows[~several], told])
        yield from _dealt(asked, (asked["a"] % np.uint64(parts)).astype(np.int64), known=False)

    held, n = [], 0
    for b in batches:
        for r in b.to_pylist():
            first, second = window_hashes(r["bytes"])
            own = np.empty(len(first), _WINDOW)
            own["a"], own["b"], own["key"], own["size"], own["copies"] = first, second, r["key"], r["size"], r["copies"]
            own["start"] = r["start"] + np.arange(len(first))
            held.append(own)
            n += len(own)
            if n > HELD_WINDOWS:
                yield from flush()
                held, n = [], 0
    if held:
        yield from flush()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The windows of each part that this task has."""
    parts: dict[int, list[bytes]] = {}
    for b in batches:
        for part, blob in zip(b.column("part").to_pylist(), b.column("windows").to_pylist(), strict=True):
            parts.setdefault(part, []).append(blob)
    for part in list(parts):
        yield np.frombuffer(b"".join(parts.pop(part)), _WINDOW)


def _counted(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Those windows that occur more than once, dealt out by their texts."""
    asked = []
    for b in batches:
        known = b.column("known")
        yield b.filter(known)
        asked.append(b.filter(pc.invert(known)))
    for windows in _gathered(iter(asked)):
        windows = windows[np.lexsort((windows["b"], windows["a"]))]
        group = np.cumsum(_new(windows)) - 1
        windows = windows[(np.bincount(group, windows["copies"])[group] > 1) & (windows["size"] > 0)]
        if len(windows):
            yield from _dealt(windows, windows["key"] % parts, known=True)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows that follow each other in a text, as one span."""
    for windows in _gathered(batches):
        windows = windows[np.lexsort((windows["start"], windows["size"], windows["key"]))]
        same = (np.diff(windows["key"]) == 0) & (np.diff(windows["size"]) == 0) & (np.diff(windows["start"]) <= 1)
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        last = np.append(head[1:], len(windows)) - 1
        own = windows[head]
        yield pa.RecordBatch.from_arrays([pa.array(own["key"]), pa.array(own["size"]), pa.array(own["start"]), pa.array(windows["start"][last] - own["start"] + np.int32(1))], ["key", "size", "start", "windows"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each open run."""
    names = ["name", "hot", "content", "key", "size", "start", "state", "copies", "bytes"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    for b in batches:
        out = []
        for text, key, size, copies, found in zip(utf8(b.column("text")), *(b.column(c).to_pylist() for c in ("key", "size", "copies", "runs")), strict=True):
            out += [(r["name"], r["hot"], r["content"], key, size, r["start"], r["state"], copies, text[r["start"] : r["start"] + r["windows"] + WINDOW - 1]) for r in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _remove(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        removed, spans, kept, null = [], [], [], b.column("text").is_null()
        for text, found in zip(utf8(b.column("text")), b.column("spans").to_pylist(), strict=True):
            text, last, pieces, n = text or b"", 0, [], 0
            at = -1  # where the span that is open ends
            for r in sorted(found or [], key=lambda r: r["start"]):
                start, end = r["start"], r["start"] + r["windows"] + WINDOW - 1
                if start > at:
                    pieces.append(text[last if at < 0 else at : start])
                    n += 1
                    last = start
                at = max(at, end)
            pieces.append(text[max(at, 0) :])
            kept.append(b"".join(pieces))
            spans.append(n)
            removed.append(len(text) - len(kept[-1]))
        sizes = pa.array([len(k) + r for k, r in zip(kept, removed, strict=True)], pa.int64())
        rest = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        rest = pc.if_else(null, None, rest) if as_text else rest
        yield pa.RecordBatch.from_arrays([b.column("row"), sizes, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), rest], ["row", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, as_text: bool = False, text_col: str = "text") -> DataFrame:
    """Each document without the bytes of 200-byte strings that also start elsewhere.

    Texts are UTF-8 bytes; strings don't cross documents; one that starts twice
    in a document is repeated; strings are judged on the input.  Returns row
    (the document's other columns, so that no name can clash), n_bytes,
    n_removed, n_spans (maximal removed runs), kept (the remaining bytes; with
    ``as_text`` a string, without the characters that a cut has gone through).

    Very long texts are scanned by themselves, one in a batch of work.  Null texts
    are empty, with ``as_text`` what is kept of them is null.  Texts of under 200 bytes are kept whole.  Rows are
    told apart by their texts alone (64-bit hash and size), so repeated or null
    ids do no harm; equal texts have equal results.
    """
    keys = ["key", "size"]
    base = docs.select(F.struct(F.lit(0).alias("_"), *[docs[c] for c in docs.columns if c != text_col]).alias("row"), docs[text_col].cast("string").alias("text"))
    base = base.withColumns({"key": F.xxhash64("text"), "size": F.coalesce(F.octet_length("text"), F.lit(0))})
    long = base.where(F.col("size") >= WINDOW)

    scanned = map_arrow(long.select("key", "text"), _scan, _RUN)
    met = stored(map_arrow(scanned.repartition("route"), _meet, _RUN).drop("route", "named"), "runs")

    open_runs = met.where(F.col("state") >= OPEN)
    hot = stored(open_runs.groupBy("name").count().where(F.col("count") > HOT_CONTENTS).select("name", "count", F.lit(True).alias("hot")), "hot-names")
    marked = open_runs.join(hot.drop("count"), "name", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    of_text = marked.groupBy(*keys).agg(F.collect_set(F.struct("name", "hot", "content", "start", "windows", "state")).alias("runs"))
    texts = long.groupBy(*keys).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    segment_fields = [("name", "long"), ("hot", "boolean"), ("content", "long"), ("key", "long"), ("size", "int"), ("start", "int"), ("state", "int"), ("copies", "long"), ("bytes", "binary")]
    segments = stored(map_arrow(texts.join(of_text, keys).select("text", *keys, "copies", "runs"), _cut, segment_fields), "segments")

    span_fields = [("key", "long"), ("size", "int"), ("start", "int"), ("windows", "int")]
    blob_fields = [("part", "int"), ("known", "boolean"), ("windows", "binary")]
    parts = max(PARTS, -(-(hot.agg(F.sum("count")).first()[0] or 0) * RUN_WINDOWS // HELD_WINDOWS))
    ordered = map_arrow(segments.where("not hot").repartition("name"), _order, span_fields)
    dealt = map_arrow(segments.where("hot").select("key", "size", "start", "copies", "bytes"), partial(_windows, parts=parts), blob_fields)
    counted = map_arrow(dealt.repartition("part"), partial(_counted, parts=parts), blob_fields)
    counted = map_arrow(counted.repartition("part"), _joined, span_fields)
    whole = met.where(F.col("state").isin(WHOLE, PARTNER)).select("key", "size", "start", "windows")

    spans = ordered.unionByName(counted).unionByName(whole)
    by_text = stored(spans.groupBy(*keys).agg(F.collect_set(F.struct("start", "windows")).alias("spans")), "spans")
    discard(met, hot, segments)
    joined = base.join(by_text, keys, "left").select("row", "text", "spans")
    fields = [("row", joined.schema["row"].dataType), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "string" if as_text else "binary")]
    return map_arrow(joined, partial(_remove, as_text=as_text), fields)
