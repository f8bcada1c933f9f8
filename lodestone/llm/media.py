"""Media in binary columns: types from signatures, structure checks, carved parts."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import id_type, map_arrow, narrowed, stored

# The formats' magic bytes, as their specifications give them.
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
SIGNATURES = {
    PNG_MAGIC: "png",
    b"GIF87a": "gif",
    b"GIF89a": "gif",
    b"\xff\xd8\xff": "jpeg",
    b"RIFF": "riff",
    b"BM": "bmp",
    b"%PDF-": "pdf",
    b"PK\x03\x04": "zip",
    b"OggS": "ogg",
    b"\x1f\x8b\x08": "gzip",
}

Found = tuple[str, int]  # a type and a length in bytes


def _png(d: bytes, at: int, _: Marks) -> Found | None:
    i = at + 8
    while i + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, i)
        end = i + 12 + n
        if end > len(d) or zlib.crc32(d[i + 4 : end - 4]) != struct.unpack_from(">I", d, end - 4)[0] or (i == at + 8 and kind != b"IHDR"):
            return None
        if kind == b"IEND":
            return "image/png", end - at
        i = end
    return None


def _gif(d: bytes, at: int, _: Marks) -> Found | None:
    if at + 13 > len(d):
        return None

    def table(flags: int) -> int:
        return 3 << (flags & 7) + 1 if flags & 128 else 0

    def blocks(i: int) -> int:
        while i < len(d) and d[i]:
            i += d[i] + 1
        return i + 1

    i = at + 13 + table(d[at + 10])
    while i < len(d):
        if d[i] == 0x3B:
            return "image/gif", i + 1 - at
        if d[i] == 0x21:
            i = blocks(i + 2)
        elif d[i] == 0x2C and i + 10 < len(d):
            i = blocks(i + 11 + table(d[i + 9]))
        else:
            return None
    return None


def _jpeg(d: bytes, at: int, _: Marks) -> Found | None:
    i = at + 2
    while i + 4 <= len(d) and d[i] == 0xFF:
        mark, n = d[i + 1], struct.unpack_from(">H", d, i + 2)[0]
        if mark == 0xD9:
            return None  # no scan before the end
        if mark < 0xC0 or n < 2:
            return None
        i += 2 + n
        while mark == 0xDA:  # entropy-coded data, up to the next marker that isn't stuffing or a restart
            i = d.find(b"\xff", i)
            if i < 0 or i + 1 >= len(d):
                return None
            if d[i + 1] == 0xD9:
                return "image/jpeg", i + 2 - at
            if d[i + 1] and not 0xD0 <= d[i + 1] <= 0xD7:
                break
            i += 2
    return None


def _riff(d: bytes, at: int, _: Marks) -> Found | None:
    if at + 12 > len(d):
        return None
    n, form = struct.unpack_from("<I4s", d, at + 4)
    end, i, parts = at + 8 + n, at + 12, []
    if end > len(d) or form not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    while i + 8 <= end:
        kind, size = struct.unpack_from("<4sI", d, i)
        parts.append(kind)
        i += 8 + size + (size & 1)
    if i != end or not parts or (form == b"WAVE" and not {b"fmt ", b"data"} <= set(parts)):
        return None
    return {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}[form], n + 8


def _bmp(d: bytes, at: int, _: Marks) -> Found | None:
    if at + 30 > len(d):
        return None
    size, _reserved, pixels, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", d, at + 2)
    if header not in (12, 40, 52, 56, 64, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or not 14 + header <= pixels <= size <= len(d) - at or width <= 0 or not height:
        return None
    return "image/bmp", size


class Marks:
    """Where byte strings occur in some bytes, each located once however often it is asked for."""

    def __init__(self, d: bytes):
        self.d, self.places = d, {}

    def after(self, mark: bytes, at: int) -> int:
        """The first place from ``at`` on, or the end of the bytes."""
        if mark not in self.places:
            self.places[mark] = [m.start() for m in re.finditer(re.escape(mark), self.d)]
        places = self.places[mark]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else len(self.d)


def _pdf(d: bytes, at: int, marks: Marks) -> Found | None:
    end = marks.after(b"%%EOF", at)
    return None if end == len(d) or marks.after(b"startxref", at) + 9 > end else ("application/pdf", end + 5 - at)


def _zip(d: bytes, at: int, marks: Marks) -> Found | None:
    end = marks.after(b"PK\x05\x06", at)
    if end + 22 > len(d):
        return None
    size, start, note = struct.unpack_from("<IIH", d, end + 12)
    stop = end + 22 + note
    return None if at + start + size != end or stop > len(d) else ("application/zip", stop - at)


def _ogg(d: bytes, at: int, _: Marks) -> Found | None:
    i = at
    while d[i : i + 4] == b"OggS" and i + 27 <= len(d) and d[i + 4] == 0:
        n = d[i + 26]
        end = i + 27 + n + sum(d[i + 27 : i + 27 + n])
        if end > len(d):
            return None
        if d[i + 5] & 4:
            return "audio/ogg", end - at
        i = end
    return None


def _gzip(d: bytes, at: int, _: Marks) -> Found | None:
    reader, i = zlib.decompressobj(31), at
    try:
        while not reader.eof:  # what it unpacks to isn't kept
            if i >= len(d) and not reader.unconsumed_tail:
                return None
            part = reader.unconsumed_tail or d[i : i + 65536]
            i += 0 if reader.unconsumed_tail else len(part)
            reader.decompress(part, 1 << 20)
    except zlib.error:
        return None
    return "application/gzip", i - len(reader.unused_data) - at


VALIDATORS: dict[str, Callable[[bytes, int, Marks], Found | None]] = {"png": _png, "gif": _gif, "jpeg": _jpeg, "riff": _riff, "bmp": _bmp, "pdf": _pdf, "zip": _zip, "ogg": _ogg, "gzip": _gzip}


def signatures() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic, kind in SIGNATURES.items():
        out.add_word(magic.decode("latin-1"), (len(magic), kind))
    out.make_automaton()
    return out


def sniff(data: bytes, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(offset, length, type) of all media whose structure holds.

    One that lies inside another found before it is kept too (it is carved out
    of it); a match whose structure doesn't hold is no media.
    """
    out, marks = [], Marks(data)
    for last, (n, kind) in automaton.iter(data.decode("latin-1")):
        at = last - n + 1
        if found := VALIDATORS[kind](data, at, marks):
            out.append((at, found[1], found[0]))
    return out


def sniff_column(media: DataFrame, data_col: str = "media", declared_col: str = "declared", id_col: str = "doc_id") -> DataFrame:
    """Check each row's bytes against its declared type.

    Returns doc_id, media, declared, type (the media that fills the bytes, else
    ``application/octet-stream``; null for null bytes), corrected (the declared
    type is another or null), parts (offset, length, type, and a SHA-256 of each
    medium that is carved out of the bytes, the whole excepted).
    """
    base = media.select(media[id_col].alias("doc_id"), media[data_col].alias("media"), media[declared_col].alias("declared"))
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("sha256", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = signatures()
        for b in batches:
            types, fixed, parts = [], [], []
            for data, declared in zip(b.column("media").to_pylist(), b.column("declared").to_pylist(), strict=True):
                found = sniff(data or b"", automaton)
                whole = next((t for at, n, t in found if at == 0 and n == len(data)), "application/octet-stream") if data is not None else None
                types.append(whole)
                fixed.append(whole is not None and whole != declared)
                parts.append([{"offset": at, "length": n, "type": t, "sha256": hashlib.sha256(data[at : at + n]).hexdigest()} for at, n, t in found if n != len(data)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(types, pa.string()), pa.array(fixed, pa.bool_()), pa.array(parts, kind)], [*b.schema.names, "type", "corrected", "parts"])

    fields = [("doc_id", id_type(base)), ("media", "binary"), ("declared", "string"), ("type", "string"), ("corrected", "boolean"), ("parts", "array<struct<offset:long,length:long,type:string,sha256:string>>")]
    return map_arrow(base, scan, fields)


UNIT = 192


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """One channel of 8-bit samples, as they are."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def wav_samples(data: bytes) -> bytes:
    i, end = 12, len(data)
    while i + 8 <= end:
        kind, n = struct.unpack_from("<4sI", data, i)
        if kind == b"data":
            return data[i + 8 : i + 8 + n]
        i += 8 + n + (n & 1)
    raise ValueError("no samples")


def text_media(docs: DataFrame, declared: str = "text/plain", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media, declared): each text's UTF-8 bytes as 8-bit samples.

    Null texts are empty; spaces fill the samples to a positive multiple of 192.
    """
    base = narrowed(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column("data").to_pylist()
            media = [wav(d.ljust(max(1, -(-len(d) // UNIT)) * UNIT, b" ")) for d in data]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(d) for d in data], pa.int64()), pa.array(media, pa.binary()), pa.array([declared] * len(data))], ["doc_id", "n_bytes", "media", "declared"])

    return map_arrow(base, store, [("doc_id", id_type(base)), ("n_bytes", "long"), ("media", "binary"), ("declared", "string")])


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of stored media: what ``text_media`` wrote, read back.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the
    last 16 bytes), media_bytes, media_sha256, feature (the type that the bytes
    show, samples, their mean and peak difference in thousandths, media carved).
    """
    sniffed = sniff_column(media.withColumn("key", F.struct("doc_id", "n_bytes")), id_col="key")
    inner = sniffed.select("doc_id.*", "media", "type", "corrected", F.size("parts").cast("long").alias("carved"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, kind, carved in zip(b.column("media").to_pylist(), b.column("type").to_pylist(), b.column("carved").to_pylist(), strict=True):
                samples = wav_samples(data)
                level = np.frombuffer(samples, np.uint8)
                steps = np.abs(np.diff(level.astype(np.int16)))
                feature = f"{kind};samples={len(samples)};mean={int(level.sum(dtype=np.int64)) * 1000 // len(samples)};step={int(steps.sum(dtype=np.int64)) * 1000 // max(1, len(steps))};carved={carved}"
                out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            columns = [pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *columns], [f[0] for f in fields])

    kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    fields = [("doc_id", id_type(inner)), ("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]
    return map_arrow(inner, read, fields)


def stored_media(docs: DataFrame) -> DataFrame:
    """Write each text as media to the shared folder, read it back, and describe it."""
    return media_features(stored(text_media(docs), "media"))
