"""Media: stored payloads against the texts, validators on files built here, carving, odd tables."""

import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import media


def test_payload(docs, texts):
    apart = media.wave_features(media.sniff(media.store_texts(docs), "blob", "declared")).selectExpr("doc_id", "n_bytes", "sniffed.corrected corrected_type", *media.FEATURES).collect()
    out = media.describe_texts(docs).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, apart)) and len(out) == len(texts)
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.wav(payload)
        assert (r.media_bytes, r.media_sha256, r.corrected_type) == (len(stored), hashlib.sha256(stored).hexdigest(), "audio/wav")


def png():
    def chunk(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0\0\0\1\0\0\0\1\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def archive(*names, inner=b"hello"):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        for n in names:
            f.writestr(n, inner)
    return z.getvalue()


def crc(data, bits, poly):
    """Bit by bit, high bit first, from 0."""
    out = 0
    for x in data:
        out ^= x << (bits - 8)
        for _ in range(8):
            out = ((out << 1) ^ (poly if out >> (bits - 1) else 0)) & ((1 << bits) - 1)
    return out


def flac(frames=3, blocks=4096, known=True):
    total = frames * blocks if known else 0
    info = struct.pack(">HH", blocks, blocks) + b"\0" * 6 + ((44100 << 44) | (15 << 36) | total).to_bytes(8, "big") + b"\0" * 16
    out = b"fLaC" + b"\x80\0\0\x22" + info
    for n in range(frames):
        head = b"\xff\xf8\xc9\x08" + bytes([n])  # 4096 samples, 44.1 kHz, mono, 16 bits
        head += bytes([crc(head, 8, 0x07)])
        frame = head + b"\0" + struct.pack(">h", 700 * n - 1)  # one constant subframe
        out += frame + crc(frame, 16, 0x8005).to_bytes(2, "big")
    return out


def ogg(serials=(1,), pages=3):
    out = b""
    for k in range(pages):
        for s in serials:
            flag = 2 if k == 0 else 4 if k == pages - 1 else 0
            body = bytes([s]) * 40
            page = b"OggS\0" + bytes([flag]) + b"\0" * 8 + s.to_bytes(4, "little") + k.to_bytes(4, "little") + b"\0\0\0\0\1" + bytes([len(body)]) + body
            out += page[:22] + crc(page, 32, 0x04C11DB7).to_bytes(4, "little") + page[26:]
    return out


def mp3(frames=4):
    return b"ID3\x03\0\0\0\0\0\x05abcde" + (b"\xff\xfb\x90\0" + b"\0" * 413) * frames  # 128 kbit/s at 44.1 kHz


def tiff(order="<"):
    entries = [(256, 3, 1, 1), (273, 4, 1, 100), (279, 4, 1, 6)]
    out = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8) + struct.pack(order + "H", 3)
    for tag, kind, n, value in entries:
        out += struct.pack(order + ("HHIHH" if kind == 3 else "HHII"), tag, kind, n, value, *([0] if kind == 3 else []))
    return (out + b"\0\0\0\0").ljust(100, b"\0") + b"strip!"


def box(name, body):
    return struct.pack(">I4s", 8 + len(body), name) + body


GIF = b"GIF89a\1\0\1\0\0\0\0" + b"\x2c\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x06abcd\xff\xda\0\x04xy\x11\xff\0\x22\xff\xd0\x33\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nstartxref\n0\n%%EOF"
AGAIN = PDF + b"\n2 0 obj\nxref\nstartxref\n50\n%%EOF"
EBML = b"\x1a\x45\xdf\xa3\x87\x42\x82\x84webm"
MADE = {
    "image/png": [png()], "image/gif": [GIF], "image/jpeg": [JPEG], "application/gzip": [gzip.compress(b"x" * 99), gzip.compress(b"\0" * 5_000_000)],
    "application/zip": [archive("a.txt"), archive("a.txt", "b.txt"), archive("in.zip", inner=archive("a", "b"))], "audio/wav": [media.wav(b"abc")],
    "application/pdf": [PDF, AGAIN], "audio/flac": [flac(), flac(1), flac(known=False)], "audio/ogg": [ogg(), ogg((1, 2)), ogg() + ogg((7,))], "audio/mpeg": [mp3(), mp3() + b"TAG".ljust(128, b"\0")],
    "image/tiff": [tiff("<"), tiff(">")], "video/mp4": [box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", b"x" * 9) + box(b"mdat", b"y" * 5)],
    "image/avif": [box(b"ftyp", b"avif\0\0\0\0") + box(b"meta", b"x")], "video/webm": [EBML + b"\x18\x53\x80\x67\x83abc"],
}


@pytest.mark.parametrize("kind", MADE)
def test_lengths(kind):
    for blob in MADE[kind]:
        assert media.scan(blob)[0] == (0, kind, len(blob))
        assert (7, kind, len(blob)) in media.scan(b"BMRIFF?" + blob + b" tail of no kind")
        assert (7, kind, len(blob)) in media.scan(b"BMRIFF?" + blob + png())
        if kind not in ("audio/flac", "audio/mpeg", "video/mp4"):  # these may end after any frame or box
            assert not [x for x in media.scan(blob[:-1]) if x[0] == 0 and x[2] >= len(blob) - 1]


def test_media_in_media_and_side_by_side():
    inner = archive("a", "b")
    outer = archive("in.zip", inner=inner)
    assert {(k, n) for _, k, n in media.scan(outer)} == {("application/zip", len(outer)), ("application/zip", len(inner))}
    two = media.scan(PDF + b"\n" + AGAIN)
    assert two == [(0, "application/pdf", len(PDF)), (len(PDF) + 1, "application/pdf", len(AGAIN))]
    bad = bytearray(ogg())
    bad[40] ^= 1
    assert not media.scan(bytes(bad))


@pytest.mark.parametrize("magic", [*media.MAGIC, b"PK\x05\x06", b"%%EOF", b"\xff\xd8\xff\xda\0\x02", b"OggS\0\2" + b"\0" * 21, GIF[:13] + b"!\0\0"])
def test_repeated_magic_is_linear(magic):
    began = time.perf_counter()
    media.scan(magic * (200_000 // len(magic)))
    assert time.perf_counter() - began < 2


def test_sniff_and_carve(spark):
    rows = [(1, b"junk" + png() + b"..", "image/png"), (2, GIF, "image/png"), (3, None, "text/plain"), (4, b"", None), (2, GIF, "image/png")]
    df = spark.createDataFrame(rows, "id int, blob binary, declared string")
    seen = media.sniff(df, "blob", "declared")
    got = {r.id: r.sniffed for r in seen.collect()}
    assert got[1].type is None and got[1].corrected == "image/png" and [(e.offset, e.type) for e in got[1].embedded] == [(4, "image/png")]
    assert got[2].corrected == "image/gif" and got[2].mismatch and seen.count() == 5
    assert got[3].corrected == "text/plain" and not got[3].embedded
    assert [(r.id, bytes(r.bytes)) for r in media.carve(seen).collect()] == [(1, png())]
    clash = df.withColumns({"sniffed": F.lit(1), "offset": F.lit(2), "Type": F.lit(3), "e": F.lit(4), "payload_bytes": F.lit(5), "f": F.lit(6)})
    again = media.sniff(clash, "blob", "declared")
    assert [(r.id, r.offset, r.e, bytes(r.bytes)) for r in media.carve(again).collect()] == [(1, 4, 4, png())]
    assert {r.payload_bytes for r in media.wave_features(again).collect()} == {None}


def test_empty_tables(docs):
    none = docs.limit(0)
    assert media.describe_texts(none).count() == media.wave_features(media.sniff(media.store_texts(none))).count() == 0
    assert media.carve(media.sniff(media.store_texts(none))).count() == 0
