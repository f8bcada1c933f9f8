"""Token sequences of fixed length with the least slack, by subset sums."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import encoder
from lodestone.llm.scratch import id_type, map_arrow, narrowed, prefix_frame, stored

#: Pieces that are packed together; more than that are packed pool by pool.
POOL = 8192


def least_slack(counts: list[int], room: int) -> list[tuple[int, int]]:
    """Lengths to take, with their multiplicities, for the sum nearest to ``room``.

    ``counts[n]`` pieces of length n are left.  A bitset has a bit for each sum
    that the lengths seen so far can make; lengths come in descending order,
    each with its count in binary parts, until ``room`` itself is reached.  The
    bitsets before each part lead back from the best sum to its pieces.
    """
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in range(room, 0, -1):
        left, part = min(counts[n], room // n), 1
        while left:
            take = min(part, left)
            steps.append((n, take, reach))
            reach |= reach << (n * take) & full
            left, part = left - take, part * 2
        if reach >> room:
            break
    best, taken = reach.bit_length() - 1, defaultdict(int)
    for n, take, before in reversed(steps):
        if not before >> best & 1:
            taken[n] += take
            best -= n * take
    return list(taken.items())


class _Packer:
    """One partition's open pieces by length, and the numbers of its sequences."""

    def __init__(self, capacity: int):
        self.capacity, self.sequence, self.open = capacity, 0, 0
        self.counts = [0] * (capacity + 1)
        self.pieces: dict[int, list] = defaultdict(list)

    def add(self, piece: tuple) -> None:
        n = piece[2]
        self.counts[n] += 1
        self.pieces[n].append(piece)
        self.open += 1

    def take(self, n: int) -> tuple:
        self.counts[n] -= 1
        self.open -= 1
        return self.pieces[n].pop()

    def close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for name, start, n, ids, total in pieces:
            yield name, start, n, ids, total, self.sequence, offset
            offset += n
        self.sequence += 1

    def pack(self, until: int) -> Iterator[tuple]:
        """Fill windows until so many pieces are open: the longest piece first,
        then the multiset of lengths that comes nearest to the room it leaves.
        Where none fills it and longer pieces are left, the shortest of these
        is cut to fill it; with ``until`` 0 the last window may stay unfilled."""
        longest = self.capacity
        while self.open > until:
            while not self.counts[longest]:
                longest -= 1
            window = [self.take(longest)]
            room = self.capacity - longest
            for n, times in least_slack(self.counts, room) if room else []:
                window += [self.take(n) for _ in range(times)]
                room -= n * times
            if room and self.open:
                n = next(n for n in range(room + 1, self.capacity + 1) if self.counts[n])
                name, start, _, ids, total = self.take(n)
                window.append((name, start, room, ids[: 4 * room], total))
                self.add((name, start + room, n - room, ids[4 * room :], total))
            yield from self.close(window)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document's ids, ``end_id`` after them, into windows of ``capacity``.

    A document gives as many full windows as it can; what remains is a piece.
    Each partition packs its own pieces, so that no ids are shuffled: a window
    takes the longest open piece and the multiset of other lengths with least
    slack.  Only the last window of a partition can stay unfilled.  A sum of
    windows by partition numbers them in the whole.

    Returns a row for each piece: doc_id, start (ids of the document before
    it), length, ids_crc32, doc_tokens, sequence_id, offset; and ids with
    ``with_ids``.  Null and empty texts are ``end_id`` alone.  A very long text is
    full windows and one piece.  Repeated rows are packed each by itself, rows
    of equal length in whatever order they come.  No documents: no rows.
    """
    spark, base = docs.sparkSession, narrowed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    end = np.array([end_id], "<u4").tobytes()
    fields = [("doc_id", id_type(base)), ("start", "long"), ("length", "int"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("part", "int"), ("window", "long"), ("offset", "long")] + [("ids", "binary")] * with_ids

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, packer = encoder(tokenizer_path), TaskContext.get().partitionId(), _Packer(capacity)
        kind, rows = None, []

        def batch() -> pa.RecordBatch:
            name, start, n, ids, total, window, offset = map(list, zip(*rows, strict=True))
            columns = [pa.array(name, kind), pa.array(start, pa.int64()), pa.array(n, pa.int32()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(total, pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(window, pa.int64()), pa.array(offset, pa.int64())]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, [f[0] for f in fields])

        for b in batches:
            kind = b.column("doc_id").type
            for name, ids in zip(b.column("doc_id").to_pylist(), enc.ids(b.column("text").to_pylist()), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = (name, start, min(capacity, total - start), ids[4 * start : 4 * (start + capacity)], total)
                    if piece[2] == capacity:
                        rows += packer.close([piece])
                    else:
                        packer.add(piece)
            if packer.open > POOL:
                rows += packer.pack(POOL // 2)
            if rows:
                yield batch()
        rows += packer.pack(0)
        if rows:
            yield batch()

    pieces = stored(map_arrow(base, pack, fields), "packed")
    totals = [tuple(r) for r in pieces.groupBy("part").agg((F.max("window") + 1).alias("n")).collect()]  # a row for each partition
    placed = pieces.join(prefix_frame(spark, totals, "part int, windows_before long"), "part")
    return placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("windows_before") + F.col("window")).alias("sequence_id"), "offset", *["ids"] * with_ids)
