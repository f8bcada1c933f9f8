"""Token ids in directly addressable code files.

A segment holds the ids of consecutive documents.  Each id is split into bytes,
lowest first: level 0 has the lowest byte of every id and a bit for each that
tells whether the id goes on; level 1 has the next byte of those that go on,
and so on.  A directory of ranks over each bitmap leads from an id's place in
one level to its place in the next, so that any id is read with a few look-ups
and nothing before it is decoded.

Layout of a segment, little-endian: magic ``DAC1``, unsigned 64-bit number of
ids, unsigned 8-bit number of levels; for each level an unsigned 64-bit number
of codes, the codes (a byte each), and, but for the last level, the bitmap
(lowest bit first, padded to bytes) and the ranks (unsigned 32-bit: set bits
before each run of 512 bits).

Segments lie in Parquet files as they are, each the one row of a row group,
neither compressed nor dictionary-coded, so that its last bytes are the end of
the column's chunk: ``read_ids`` seeks to a few bytes there.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bpe import encoder
from lodestone.llm.scratch import id_type, map_arrow, narrowed, prefix_frame, scratch_path

MAGIC = b"DAC1"
RUN = 512
#: A segment ends with the document that brings it to so many ids.
SEGMENT_IDS = 500_000
#: So that each row is a row group of plain bytes.
LAYOUT = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def encode_segment(ids: np.ndarray) -> bytes:
    """Ids (unsigned 32-bit) to a segment."""
    rest, levels = np.ascontiguousarray(ids, "<u4"), []
    while True:
        more = rest > 255
        levels.append((rest & 255).astype(np.uint8))
        if not more.any():
            break
        levels.append(more)
        rest = rest[more] >> 8
    out = [MAGIC, struct.pack("<QB", len(ids), len(levels) // 2 + 1)]
    for i in range(0, len(levels), 2):
        out += [struct.pack("<Q", len(levels[i])), levels[i].tobytes()]
        if i + 1 < len(levels):
            bits = np.packbits(levels[i + 1], bitorder="little")
            whole = np.zeros(-(-len(levels[i + 1]) // RUN) * RUN, np.uint8)
            whole[: len(levels[i + 1])] = levels[i + 1]
            ranks = np.zeros(len(whole) // RUN, "<u4")
            ranks[1:] = np.cumsum(whole.reshape(-1, RUN).sum(1, dtype=np.int64))[:-1]
            out += [bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Segment:
    """Random access to the ids of a segment: bytes, or what reads ``n`` bytes from an offset on."""

    def __init__(self, source: bytes | Callable[[int, int], bytes]):
        self.read = source if callable(source) else lambda at, n: source[at : at + n]
        head = self.read(0, 13)
        if head[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        self.n, count = struct.unpack_from("<QB", head, 4)
        at, self.levels = 13, []  # places of codes, bitmap and ranks
        for level in range(count):
            (n,) = struct.unpack("<Q", self.read(at, 8))
            codes, at = at + 8, at + 8 + n
            if level + 1 < count:
                self.levels.append((codes, at, at + -(-n // 8)))
                at += -(-n // 8) + 4 * -(-n // RUN)
            else:
                self.levels.append((codes, None, None))

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place ``i`` of a level's bitmap."""
        _, bits, ranks = self.levels[level]
        run, inside = divmod(i, RUN)
        if not inside:  # the place after the last may begin a run that isn't there
            return self._rank(level, i - 1) + self._bit(level, i - 1) if i else 0
        (before,) = struct.unpack("<I", self.read(ranks + 4 * run, 4))
        window = int.from_bytes(self.read(bits + run * RUN // 8, -(-inside // 8)), "little")
        return before + (window & ((1 << inside) - 1)).bit_count()

    def _bit(self, level: int, i: int) -> int:
        return self.read(self.levels[level][1] + (i >> 3), 1)[0] >> (i & 7) & 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (codes, bits, _) in enumerate(self.levels):
            value |= self.read(codes + i, 1)[0] << (8 * level)
            if bits is None or not self._bit(level, i):
                break
            i = self._rank(level, i)
        return value

    def span(self, first: int, past: int) -> np.ndarray:
        """The ids from one place to another; the ids that go on in the next level stand together there."""
        if not 0 <= first <= past <= self.n:
            raise IndexError((first, past))
        parts = []
        for level, (codes, bits, _) in enumerate(self.levels):
            value = np.frombuffer(self.read(codes + first, past - first), np.uint8)
            more = None
            if bits is not None:
                raw = np.frombuffer(self.read(bits + (first >> 3), -(-past // 8) - (first >> 3)), np.uint8)
                more = np.unpackbits(raw, bitorder="little")[first & 7 :][: past - first].view(bool)
                begin = self._rank(level, first) if first else 0
                first, past = begin, begin + int(more.sum())
            parts.append((value, more))
        above = None
        for value, more in reversed(parts):
            value = value.astype("<u4")
            if more is not None:
                value[more] |= above << 8
            above = value
        return above

    def all(self) -> np.ndarray:
        """Every id."""
        return self.span(0, self.n)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text and ``end_id`` after it, in ascending id order.

    Texts are range partitioned by id and a hash, and sorted (their ids would
    take as much room on the way: measured, 523 MB against 559); each partition
    writes its segments into one file of the Parquet folder ``path``: part,
    tokens before the segment in its part, ids and lengths of its documents,
    number of ids, bytes of the segment, the segment.

    Null texts count as empty (``end_id`` alone); rows without an id come
    first; rows that repeat an id stand together, ordered by the hash of their
    texts and these, and needn't be in one partition.  A document isn't split
    over segments, so that its ids must fit a worker.
    """
    base = narrowed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = id_type(base)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        names, lengths, held, size, id_kind = [], [], [], 0, None

        def segment() -> pa.RecordBatch:
            blob = encode_segment(np.frombuffer(b"".join(held), "<u4"))
            columns = [([part], pa.int32()), ([before], pa.int64()), ([names], pa.list_(id_kind)), ([lengths], pa.list_(pa.int64())), ([size], pa.int64()), ([len(blob)], pa.int64()), ([blob], pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], [f[0] for f in fields])

        for b in batches:
            id_kind = b.column("doc_id").type
            for name, ids in zip(b.column("doc_id").to_pylist(), enc.ids(b.column("text").to_pylist()), strict=True):
                names.append(name)
                held += [ids, end]
                lengths.append(len(ids) // 4 + 1)
                size += lengths[-1]
                if size >= SEGMENT_IDS:
                    yield segment()
                    before += size
                    names, lengths, held, size = [], [], [], 0
        if names:
            yield segment()

    hashed = base.withColumn("mark", F.xxhash64("text"))
    ranged = hashed.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").drop("mark")
    fields = [("part", "int"), ("before", "long"), ("doc_ids", T.ArrayType(kind)), ("lengths", "array<long>"), ("n_tokens", "long"), ("n_bytes", "long"), ("codes", "binary")]
    map_arrow(ranged, encode, fields).write.options(**LAYOUT).parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the ids of all files before each; a row for each partition tells the sums."""
    files = spark.read.parquet(path)
    totals = [tuple(r) for r in files.groupBy("part").agg(F.sum("n_tokens")).collect()]
    located = files.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return located.join(prefix_frame(spark, totals, "part int, part_start long"), "part").withColumn("start", F.col("part_start") + F.col("before"))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of ``path``: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it; the parts' totals,
    one for each partition that wrote, give it across files.  With
    ``with_ids`` the ids themselves are returned too.
    """
    placed = _placed(spark, path).select("doc_ids", "lengths", "codes", "start")
    kind = placed.schema["doc_ids"].dataType.elementType

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                names, lengths = b.column("doc_ids")[k].values, b.column("lengths")[k].values.to_numpy()
                ids = Segment(b.column("codes")[k].as_py()).all()
                cuts = np.concatenate([[0], np.cumsum(lengths)])
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(cuts, cuts[1:], strict=False)]
                columns = [names, pa.array(cuts[:-1] + b.column("start")[k].as_py(), pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, [f[0] for f in fields])

    fields = [("doc_id", kind), ("start", "long"), ("n_tokens", "long"), ("ids_crc32", "long")] + [("ids", "array<long>")] * with_ids
    return map_arrow(placed, decode, fields)


class Stream(io.RawIOBase):
    """A file of any store that Spark reads, as a Python file; ``taken`` counts the bytes read."""

    def __init__(self, spark: SparkSession, file: str):
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.size, self.at, self.taken = fs.getFileStatus(path).getLen(), 0, 0
        self.stream, self.copy = fs.open(path), jvm.org.apache.commons.io.IOUtils.toByteArray

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = min(n if n is not None and n >= 0 else self.size, self.size - self.at)
        if n <= 0:
            return b""
        self.stream.seek(self.at)
        out = bytes(self.copy(self.stream, n))
        self.at += len(out)
        self.taken += len(out)
        return out

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


def read_ids(spark: SparkSession, path: str, position: int, n: int = 1) -> tuple[list[int], int]:
    """(ids, bytes read of the codes): ``n`` ids from a place in the whole, without any others.

    The segment is found in the small columns; its file's footer tells where
    its bytes end, and only those that the ids need are read.  Ids that go on in
    the next segment are read there.  IndexError beyond the end.
    """
    out, taken = [], 0
    placed = _placed(spark, path).select("start", "n_tokens", "n_bytes", "file", "row")
    while n > 0:
        at = position + len(out)
        r = placed.where((F.col("start") <= at) & (F.col("start") + F.col("n_tokens") > at)).first() if at >= 0 else None
        if r is None:
            raise IndexError(at)
        with Stream(spark, r["file"]) as stream:
            group = pq.ParquetFile(stream).metadata.row_group(r["row"])
            chunk = next(c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == "codes")
            begin, stream.taken = chunk.data_page_offset + chunk.total_compressed_size - r["n_bytes"], 0

            def read(offset: int, size: int, stream: Stream = stream, begin: int = begin) -> bytes:
                stream.seek(begin + offset)
                return stream.read(size)

            first = at - r["start"]
            past = min(r["n_tokens"], first + n)
            own = Segment(read)
            found = [own[first]] if past - first == 1 else own.span(first, past).tolist()
            out += found
            n -= len(found)
            taken += stream.taken
    return out, taken


def read_document(spark: SparkSession, path: str, doc_id: object) -> list[list[int]]:
    """The ids of every document with an id, each read by its place; none if there is none."""
    placed = _placed(spark, path).where(F.array_contains("doc_ids", F.lit(doc_id))).select("start", "doc_ids", "lengths")
    out = []
    for r in placed.orderBy("start").toLocalIterator():
        ends = np.cumsum(r["lengths"])
        out += [read_ids(spark, path, r["start"] + int(z) - n, n)[0] for name, n, z in zip(r["doc_ids"], r["lengths"], ends, strict=True) if name == doc_id]
    return out


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write token files (to the shared folder if ``path`` is None) and read them back."""
    path = path or scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id)
    return read_token_files(docs.sparkSession, path)
