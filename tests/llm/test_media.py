"""Signatures, structure checks, carving, and texts as samples."""

import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

from lodestone.llm.media import PNG_MAGIC, signatures, sniff, sniff_column, stored_media, wav


def png(n=3):
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return PNG_MAGIC + part(b"IHDR", struct.pack(">IIBBBBB", n, 1, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"\0" + b"a" * n)) + part(b"IEND", b"")


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "text")
    return out.getvalue()


SAMPLES = {
    "image/png": png(),
    "image/gif": b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b"\x3b",
    "image/jpeg": b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cd" + b"data\xff\0more\xff\xd0\xff\xd9",
    "audio/wav": wav(b"samples!"),
    "image/bmp": b"BM" + struct.pack("<IHHIIiiHH", 14 + 40 + 4, 0, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 24 + b"\1\2\3\0",
    "application/pdf": b"%PDF-1.4\nstartxref\n0\n%%EOF",
    "application/zip": archive(),
    "application/gzip": gzip.compress(b"hello" * 1000),
    "audio/ogg": b"OggS\0\x06" + b"\0" * 20 + b"\x01\x05hello",
}


def test_each_format_and_its_damage():
    automaton = signatures()
    for kind, data in SAMPLES.items():
        assert (0, len(data), kind) in sniff(data, automaton), kind
        assert (0, len(data), kind) in sniff(data + b"tail", automaton) or kind == "application/zip"
        for cut in range(len(data)):
            assert all(n <= cut for _, n, _ in sniff(data[:cut], automaton))
        assert (0, len(data), kind) not in sniff(data[: len(data) - 1], automaton)
    broken = bytearray(SAMPLES["image/png"])
    broken[20] ^= 1
    assert sniff(bytes(broken), automaton) == []
    assert sniff(b"BM and PK\x03\x04 and RIFF in a text", automaton) == []


def test_types_are_corrected_and_parts_carved(spark):
    inner = SAMPLES["image/png"]
    rows = [(1, inner, "image/jpeg"), (2, inner, "image/png"), (3, b"junk" + inner + b"junk" + SAMPLES["image/gif"], "text/html"), (4, None, "x"), (5, b"", None), (6, wav(inner + b" " * (len(inner) % 2)), None)]
    got = {r["doc_id"]: r for r in sniff_column(spark.createDataFrame(rows, "doc_id long, media binary, declared string")).collect()}
    assert [(got[i]["type"], got[i]["corrected"]) for i in range(1, 7)] == [("image/png", True), ("image/png", False), ("application/octet-stream", True), (None, False), ("application/octet-stream", True), ("audio/wav", True)]
    assert [(p["offset"], p["length"], p["type"]) for p in got[3]["parts"]] == [(4, len(inner), "image/png"), (8 + len(inner), len(SAMPLES["image/gif"]), "image/gif")]
    assert got[3]["parts"][0]["sha256"] == hashlib.sha256(inner).hexdigest() and got[6]["parts"][0]["offset"] == 44


def test_texts(frame):
    texts = [None, "", "a" * 192, "é" * 97, "x" * 100_000, "PK\x03\x04 BM RIFF %PDF-", "a" * 192]
    got = {r["doc_id"]: r for r in stored_media(frame(texts)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        data += b" " * (-len(data) % 192 if data else 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(data) + 44, hashlib.sha256(wav(data)).hexdigest())
        assert r["feature"].startswith("audio/wav;") and r["feature"].endswith("carved=0")
    assert got[2]["feature"] == got[6]["feature"] and stored_media(frame([])).count() == 0


def test_marks_without_an_end_take_linear_time():
    automaton = signatures()
    for mark in (b"%PDF-", b"PK\x03\x04"):
        took = []
        for n in (1_000_000, 5_000_000):
            data = mark * (n // len(mark))
            began = time.perf_counter()
            assert sniff(data, automaton) == []
            took.append(time.perf_counter() - began)
        assert took[1] < 60 and took[1] < 15 * took[0]
