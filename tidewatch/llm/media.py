"""Media columns: Aho-Corasick finds magic bytes, validators confirm structure and length; declared types are corrected
and embedded media are carved."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.skew import fresh

#: The bytes that give a kind away, and how far into the medium they stand. Kinds that several types share
#: are told apart by their validators.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0),
    b"GIF87a": ("image/gif", 0),
    b"GIF89a": ("image/gif", 0),
    b"\xff\xd8\xff": ("image/jpeg", 0),
    b"BM": ("image/bmp", 0),
    b"II*\0": ("image/tiff", 0),
    b"MM\0*": ("image/tiff", 0),
    b"RIFF": ("riff", 0),
    b"ftyp": ("ftyp", 4),
    b"\x1a\x45\xdf\xa3": ("matroska", 0),
    b"OggS": ("audio/ogg", 0),
    b"fLaC": ("audio/flac", 0),
    b"ID3": ("audio/mpeg", 0),
    b"%PDF-": ("application/pdf", 0),
    b"PK\x03\x04": ("application/zip", 0),
    b"\x1f\x8b\x08": ("application/gzip", 0),
}
#: What ends a medium and is found by the same automaton.
TRAILERS = {b"%%EOF": "eof", b"PK\x05\x06": "zip end"}
RIFF_KINDS = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}
BRANDS = {b"heic": "image/heic", b"heix": "image/heic", b"mif1": "image/heic", b"avif": "image/avif", b"qt  ": "video/quicktime", b"M4A ": "audio/mp4"}
BOXES = {b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"meta", b"uuid", b"sidx", b"styp", b"pdin", b"emsg"}
MPEG_KBITS = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
MPEG_RATES = (44100, 48000, 32000)
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
UNIT, RATE, UNKNOWN = 192, 8000, "application/octet-stream"

Found = tuple[str, int]  # media type, length


class Blob(bytes):
    """Bytes with what one pass of the automaton found in them, so that no validator searches for an end again."""

    def note(self) -> list[tuple[int, str]]:
        self.at: dict[str, list[int]] = {}
        for end, (kind, size, before) in _automaton().iter(self.decode("latin-1")):
            self.at.setdefault(kind, []).append(end + 1 - size - before)
        self.zips, self.pages, self.ends = {begin: end for begin, end in map(self._zip_from, self.at.get("zip end", ())) if end}, set(), {}
        return sorted((at, kind) for kind in VALIDATORS for at in self.at.get(kind, ()) if at >= 0)

    def _zip_from(self, pos: int) -> tuple[int, int]:
        """Where the archive with the end record at ``pos`` begins and ends; (0, 0) if its directory is not there."""
        if pos + 22 > len(self):
            return 0, 0
        size, start = struct.unpack_from("<II", self, pos + 12)
        directory = pos
        if 0xFFFFFFFF in (size, start) and self[max(0, pos - 76) : max(0, pos - 72)] == b"PK\x06\x06":
            (size, start), directory = struct.unpack_from("<QQ", self, pos - 36), pos - 76
        begin = directory - size - start
        whole = begin >= 0 and (not size or self[directory - size : directory - size + 4] == b"PK\x01\x02")
        return (begin, pos + 22 + int.from_bytes(self[pos + 20 : pos + 22], "little")) if whole else (0, 0)

    @property
    def markers(self) -> list[int]:
        """Where JPEG scans can end: 0xFF before what is neither stuffing, a restart nor a fill byte."""
        if "markers" not in self.ends:
            self.ends["markers"] = [m.start() for m in re.finditer(rb"\xff[^\x00\xd0-\xd7\xff]", self)]
        return self.ends["markers"]


def _png(b: Blob, at: int) -> Found | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, kind = int.from_bytes(b[pos : pos + 4], "big"), b[pos + 4 : pos + 8]
        end = pos + 12 + size
        if end > len(b) or first != (kind == b"IHDR") or first and size != 13 or zlib.crc32(b[pos + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        if kind == b"IEND":
            return "image/png", end - at
        pos, first = end, False
    return None


def _gif(b: Blob, at: int) -> Found | None:
    if at + 13 > len(b):
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 128 else 0
    pos = at + 13 + table(b[at + 10])
    passed: list[int] = []  # walks that meet go on alike
    end = None

    def blocks(pos: int) -> int:
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        return pos + 1

    while pos < len(b):
        if ("gif", pos) in b.ends:
            end = b.ends["gif", pos]
            break
        passed.append(pos)
        kind = b[pos]
        if kind == 0x3B:
            end = pos + 1
            break
        if kind == 0x21:
            pos = blocks(pos + 2)
        elif kind == 0x2C and pos + 10 < len(b):
            pos = blocks(pos + 11 + table(b[pos + 9]))
        else:
            break
    b.ends.update({("gif", p): end for p in passed})
    return ("image/gif", end - at) if end else None


def _jpeg(b: Blob, at: int) -> Found | None:
    pos, scanned, passed, end = at + 2, False, [], None
    while pos + 2 <= len(b) and b[pos] == 0xFF:
        if ("jpeg", pos, scanned) in b.ends:
            end = b.ends["jpeg", pos, scanned]
            break
        passed.append((pos, scanned))
        kind = b[pos + 1]
        if kind == 0xFF:
            pos += 1
            continue
        if kind == 0xD9:
            end = pos + 2 if scanned else None
            break
        size = int.from_bytes(b[pos + 2 : pos + 4], "big")
        if size < 2 or kind < 0xC0 or pos + 4 > len(b):
            break
        pos += 2 + size
        if kind == 0xDA:
            scanned, k = True, bisect_left(b.markers, pos)
            pos = b.markers[k] if k < len(b.markers) else len(b)
    b.ends.update({("jpeg", *p): end for p in passed})
    return ("image/jpeg", end - at) if end else None


def _bmp(b: Blob, at: int) -> Found | None:
    if at + 30 > len(b):
        return None
    size, _, data, head, _, _, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    good = planes == 1 and bits in (1, 4, 8, 16, 24, 32) and head in (40, 52, 56, 108, 124) and 14 + head <= data <= size <= len(b) - at
    return ("image/bmp", size) if good else None


def _riff(b: Blob, at: int) -> Found | None:
    kind = RIFF_KINDS.get(b[at + 8 : at + 12])
    size = int.from_bytes(b[at + 4 : at + 8], "little") + 8
    if not kind or size > len(b) - at:
        return None
    pos, names = at + 12, []
    while pos + 8 <= at + size:
        names.append(b[pos : pos + 4])
        pos += 8 + (n := int.from_bytes(b[pos + 4 : pos + 8], "little")) + (n & 1)
    whole = pos in (at + size, at + size + 1) and names and (kind != "audio/wav" or {b"fmt ", b"data"} <= set(names))
    return (kind, size) if whole else None


def _bits(x: int, n: int) -> int:
    return int(f"{x:0{n}b}"[::-1], 2)


_MIRROR = bytes(_bits(x, 8) for x in range(256))


def _ogg_crc(page: bytes) -> int:
    """The checksum of a page: CRC-32 with the high bit first, from 0, with its own field as 0."""
    raw = (page[:22] + b"\0\0\0\0" + page[26:]).translate(_MIRROR)
    return _bits(zlib.crc32(raw, 0xFFFFFFFF) ^ 0xFFFFFFFF, 32)


def _ogg(b: Blob, at: int) -> Found | None:
    """Pages whose checksums hold, up to one after which every stream that began has ended; chained streams are one."""
    if at in b.pages or b[at + 5 : at + 6] not in (b"\2", b"\6"):
        return None  # a page of a stream that was walked already, or none that begins one
    pos, open_, end = at, set(), None
    while b[pos : pos + 4] == b"OggS" and pos + 27 <= len(b) and b[pos + 4] == 0:
        b.pages.add(pos)
        n = b[pos + 26]
        after = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])
        page = b[pos:after]
        if after > len(b) or _ogg_crc(page) != int.from_bytes(page[22:26], "little"):
            break
        serial = page[14:18]
        open_.add(serial) if page[5] & 2 else None
        if page[5] & 4:
            open_.discard(serial)
        pos = after
        if not open_:
            end = pos
    return ("audio/ogg", end - at) if end else None


def _table(bits: int, poly: int) -> list[int]:
    out = []
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1) ^ (poly if x >> (bits - 1) else 0)
            x &= (1 << bits) - 1
        out.append(x)
    return out


_CRC8, _CRC16 = _table(8, 0x07), _table(16, 0x8005)


def _flac_header(b: Blob, pos: int) -> tuple[int, int] | None:
    """Number and block size of the frame at ``pos`` if its header and the checksum of that hold."""
    if b[pos : pos + 1] != b"\xff" or pos + 6 > len(b) or b[pos + 1] & 0xFE != 0xF8 or b[pos + 3] & 1:
        return None
    size, rate = b[pos + 2] >> 4, b[pos + 2] & 15
    lead = b[pos + 4]
    more = max(0, f"{lead:08b}".index("0") - 1) if lead != 255 else 9
    at = pos + 5 + more
    number = lead & (0x7F >> (more + 1 if more else 0))
    for x in b[pos + 5 : at]:
        number = number << 6 | x & 63
    blocks = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    if size in (6, 7):
        blocks, at = int.from_bytes(b[at : at + size - 5], "big") + 1, at + size - 5
    at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    check = 0
    for x in b[pos:at]:
        check = _CRC8[check ^ x]
    return (number, blocks) if size and rate < 15 and at < len(b) and check == b[at] else None


def _flac(b: Blob, at: int) -> Found | None:
    """Frames, each with the number after the last one's, until the stream's samples are there; the last frame ends where
    its checksum does. A stream that does not say how many samples it has ends at the last frame found."""
    pos, info = at + 4, None
    while pos + 4 <= len(b):
        kind, size = b[pos], int.from_bytes(b[pos + 1 : pos + 4], "big")
        if info is None:
            if kind & 127 or size != 34 or pos + 38 > len(b):
                return None
            info = b[pos + 4 : pos + 38]
        pos += 4 + size
        if kind & 128:
            break
    else:
        return None
    samples, most, got = int.from_bytes(info[13:18], "big") & ((1 << 36) - 1), int.from_bytes(info[7:10], "big") or 1 << 20, 0
    frame = _flac_header(b, pos)
    while frame:
        got += frame[1]
        nxt, found = pos + 2, None
        while not (samples and got >= samples) and (nxt := b.find(b"\xff", nxt, pos + most + 2)) >= 0:
            found = _flac_header(b, nxt)
            if found and found[0] in (frame[0] + 1, frame[0] + frame[1]):
                break
            found, nxt = None, nxt + 1
        if not found:
            check = 0
            for k in range(pos, min(len(b), pos + most)):
                check = (check << 8 & 0xFFFF) ^ _CRC16[check >> 8 ^ b[k]]
                if not check and k > pos + 6:
                    return "audio/flac", k + 1 - at
            return None
        pos, frame = nxt, found
    return None


def _mpeg(b: Blob, at: int) -> Found | None:
    """An ID3 tag and the layer III frames after it, two at least, with a closing tag of 128 bytes."""
    if at + 10 > len(b) or b[at + 3] == 255 or any(x & 128 for x in b[at + 6 : at + 10]):
        return None
    pos, frames = at + 10 + sum(x << 7 * (3 - k) for k, x in enumerate(b[at + 6 : at + 10])), 0
    while pos + 4 <= len(b) and b[pos] == 255 and b[pos + 1] & 0xE6 == 0xE2:
        version, kbits, rate = b[pos + 1] >> 3 & 3, b[pos + 2] >> 4, b[pos + 2] >> 2 & 3
        if version == 1 or kbits in (0, 15) or rate == 3:
            break
        first = version == 3
        size = (144 if first else 72) * MPEG_KBITS[1 if first else 2][kbits] * 1000 // (MPEG_RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]) + (b[pos + 2] >> 1 & 1)
        if pos + size > len(b):
            break
        pos, frames = pos + size, frames + 1
    return ("audio/mpeg", pos + 128 * (b[pos : pos + 3] == b"TAG" and pos + 128 <= len(b)) - at) if frames > 1 else None


def _tiff(b: Blob, at: int) -> Found | None:
    """Directories, the values they point to, and the strips or tiles."""
    order = "<" if b[at : at + 1] == b"I" else ">"
    end, (pos,), seen = 8, struct.unpack_from(order + "I", b, at + 4) if at + 8 <= len(b) else (0,), set()
    while pos and pos not in seen:
        seen.add(pos)
        if at + pos + 6 > len(b):
            return None
        n = struct.unpack_from(order + "H", b, at + pos)[0]
        last = pos + 2 + 12 * n
        if not n or at + last + 4 > len(b):
            return None
        held: dict[int, tuple[int, ...]] = {}
        for k in range(n):
            tag, kind, count, value = struct.unpack_from(order + "HHII", b, at + pos + 2 + 12 * k)
            size = TIFF_SIZES.get(kind, 0) * count
            if not TIFF_SIZES.get(kind):
                return None
            where = pos + 10 + 12 * k if size <= 4 else value
            end = max(end, where + size)
            if at + end > len(b):
                return None
            if tag in (273, 279, 324, 325) and kind in (3, 4):
                held[tag] = struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", b, at + where)
        for x, y in ((273, 279), (324, 325)):
            end = max([end, *(i + j for i, j in zip(held.get(x, ()), held.get(y, ())))])
        end, pos = max(end, last + 4), struct.unpack_from(order + "I", b, at + last)[0]
    return ("image/tiff", end) if seen and at + end <= len(b) else None


def _ftyp(b: Blob, at: int) -> Found | None:
    """Boxes up to the first that is none of the top level; a box without a size goes to the end."""
    pos, names = at, set()
    while pos + 8 <= len(b):
        size, name, head = int.from_bytes(b[pos : pos + 4], "big"), b[pos + 4 : pos + 8], 8
        if name not in BOXES and (pos > at or name != b"ftyp"):
            break
        if size == 1:
            size, head = int.from_bytes(b[pos + 8 : pos + 16], "big"), 16
        size = size or len(b) - pos
        if size < head or pos + size > len(b):
            break
        names.add(name)
        pos += size
    return (BRANDS.get(b[at + 8 : at + 12], "video/mp4"), pos - at) if names & {b"moov", b"moof", b"meta"} else None


def _vint(b: Blob, pos: int) -> tuple[int | None, int]:
    """A size (None: unknown) and where it ends; an end past the blob if there is none."""
    n = 9 - b[pos].bit_length() if pos < len(b) else 9
    if n > 8 or pos + n > len(b):
        return None, len(b) + 1
    value = int.from_bytes(b[pos : pos + n], "big") & ((1 << 7 * n) - 1)
    return (None if value == (1 << 7 * n) - 1 else value), pos + n


def _matroska(b: Blob, at: int) -> Found | None:
    size, pos = _vint(b, at + 4)
    if size is None or pos + size + 4 > len(b):
        return None
    kind = re.search(rb"\x42\x82.(webm|matroska)", b[pos : pos + size], re.S)
    if not kind or b[pos + size : pos + size + 4] != b"\x18\x53\x80\x67":
        return None
    size, pos = _vint(b, pos + size + 4)
    end = len(b) if size is None else pos + size
    return ("video/webm" if kind[1] == b"webm" else "video/x-matroska", end - at) if pos <= end <= len(b) else None


def _pdf(b: Blob, at: int) -> Found | None:
    """Up to the last end mark before the next header: what was saved again, or for the web, has several."""
    heads, ends = b.at["application/pdf"], b.at.get("eof", [])
    k = bisect_left(heads, at + 1)
    k = bisect_left(ends, heads[k] if k < len(heads) else len(b)) - 1
    if k < 0 or ends[k] < at or not re.search(rb"startxref\s+\d+\s*$", b[max(at, ends[k] - 40) : ends[k]]):
        return None
    return "application/pdf", ends[k] + 5 - at


def _zip(b: Blob, at: int) -> Found | None:
    return ("application/zip", b.zips[at] - at) if at in b.zips else None


def _gzip(b: Blob, at: int) -> Found | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    pos = at + 10 + (2 + int.from_bytes(b[at + 10 : at + 12], "little") if b[at + 3] & 4 else 0)
    for flag in (8, 16):  # name and comment, each up to a zero
        if b[at + 3] & flag:
            low, end = b.ends.get("zero", (1, 0))
            if not low <= pos <= end:
                end = b.find(b"\0", pos)
                b.ends["zero"] = (pos, end if end >= 0 else len(b))
            end = b.ends["zero"][1]
            pos = end + 1
    if pos >= len(b):
        return None
    d = zlib.decompressobj(31)
    try:
        view = memoryview(b)[at:]
        for k in range(0, len(view), 1 << 16):
            part = view[k : k + (1 << 16)]
            while len(part) and not d.eof:
                d.decompress(part, 1 << 20)  # what comes out is not kept, however much it is
                part = d.unconsumed_tail
            if d.eof:
                return "application/gzip", min(k + (1 << 16), len(view)) - len(d.unused_data)
    except zlib.error:
        pass
    return None


VALIDATORS: dict[str, Callable[[Blob, int], Found | None]] = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "image/tiff": _tiff, "riff": _riff, "ftyp": _ftyp, "matroska": _matroska,
    "audio/ogg": _ogg, "audio/flac": _flac, "audio/mpeg": _mpeg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip,
}


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, (kind, before) in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (kind, len(magic), before))
    for mark, kind in TRAILERS.items():
        a.add_word(mark.decode("latin-1"), (kind, len(mark), 0))
    a.make_automaton()
    return a


def scan(blob: bytes) -> list[tuple[int, str, int]]:
    """Confirmed media in ``blob``: (offset, type, length) by offset. Media inside other media are listed too. The blob is
    searched once; validators follow lengths and what that search found."""
    b = Blob(blob)
    return sorted((at, *hit) for at, kind in b.note() if (hit := VALIDATORS[kind](b, at)))


SNIFFED = "type string, length long, corrected string, mismatch boolean, embedded array<struct<offset: long, type: string, length: long>>"
FEATURES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def looked(blob: bytes | None, said: str | None) -> tuple:
    """The row of :func:`sniff`."""
    found = scan(blob or b"")
    own = next(((t, n) for at, t, n in found if at == 0), (None, None))
    inner = [{"offset": at, "type": t, "length": n} for at, t, n in found if at]
    return (*own, own[0] or said, bool(own[0] and said and own[0] != said), inner)


def sniff(media: DataFrame, blob_col: str = "blob", declared_col: str | None = None) -> DataFrame:
    """``media`` with ``sniffed``: type (null if nothing is confirmed at offset 0), length, ``corrected`` (the declared
    type where nothing contradicts it, else the confirmed one), ``mismatch``, and ``embedded``: offset, type and length
    of every other confirmed medium. Whole blobs are read, one at a time, also very long ones. Null and empty blobs: type
    null, nothing embedded. Repeated rows are seen alike; of several types at one offset the first by name is the type. A
    column ``sniffed`` of the input gives way. An empty table gives an empty table."""

    @F.pandas_udf(SNIFFED)
    def look(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for blobs, declared in parts:
            yield pd.DataFrame([looked(b, said) for b, said in zip(blobs, declared)], columns=["type", "length", "corrected", "mismatch", "embedded"])

    return media.withColumn("sniffed", look(F.col(blob_col), F.col(declared_col) if declared_col else F.lit(None).cast("string")))


def carve(sniffed: DataFrame, blob_col: str = "blob") -> DataFrame:
    """One row per embedded medium of :func:`sniff`'s result: all other columns, ``offset``, ``type``, ``bytes``. Columns
    of the input with these names give way."""
    made = ("offset", "type", "bytes")
    keep = [F.col(c) for c in sniffed.columns if c not in (blob_col, "sniffed") and c.lower() not in made]
    e = fresh("e", sniffed.columns)
    rows = sniffed.withColumn(e, F.explode("sniffed.embedded"))
    bytes_ = F.substring(F.col(blob_col), F.col(f"{e}.offset").cast("int") + 1, F.col(f"{e}.length").cast("int"))
    return rows.select(*keep, F.col(f"{e}.offset").alias("offset"), F.col(f"{e}.type").alias("type"), bytes_.alias("bytes"))


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """``payload`` as the samples of an 8-bit mono WAVE file."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    body = b"WAVE" + fmt + b"data" + len(payload).to_bytes(4, "little") + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def wav_samples(blob: bytes) -> bytes:
    """The samples of an 8-bit mono WAVE file, read by its chunks."""
    pos, end = 12, 8 + int.from_bytes(blob[4:8], "little")
    while pos < end:
        size = int.from_bytes(blob[pos + 4 : pos + 8], "little")
        if blob[pos : pos + 4] == b"data":
            return blob[pos + 8 : pos + 8 + size]
        pos += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def stored(text: str | None, unit: int = UNIT) -> tuple[int, bytes]:
    """Bytes of the text, and the WAVE file of them with blanks up to a positive multiple of ``unit``."""
    raw = (text or "").encode()
    return len(raw), wav(raw + b" " * (-len(raw) % unit if raw else unit))


def read_wave(blob: bytes | None, kind: str | None, inner: list) -> tuple:
    """The columns FEATURES, read back from the stored bytes."""
    import numpy as np

    blob = blob or b""
    digest = hashlib.sha256(blob).hexdigest()
    if kind != "audio/wav":
        return None, None, None, len(blob), digest, f"{kind}"
    data = wav_samples(blob)
    channels, rate = struct.unpack_from("<HI", blob, 22)
    bits = int.from_bytes(blob[34:36], "little")
    v = np.frombuffer(data, np.uint8).astype(np.int16) - 128
    wide = v.astype(np.int64)
    signs = np.count_nonzero((v[1:] < 0) != (v[:-1] < 0))
    held = ",".join(f"{e['type']}@{e['offset']}+{e['length']}" for e in inner)
    feature = f"{kind};ch={channels};bits={bits};rate={rate};n={len(data)};mean={wide.mean():.4f};ms={(wide * wide).mean():.3f};cross={signs};held={held}"
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(blob), digest, feature


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """id, ``n_bytes``, ``blob`` (each whole text in UTF-8, blanks appended to a positive multiple of ``unit``, stored
    as a WAVE file) and its ``declared`` type, which says nothing yet. Null text: empty. Repeated rows are stored each.
    Other columns are ignored. An empty table gives an empty table."""

    @F.pandas_udf("n_bytes long, blob binary, declared string")
    def store(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in parts:
            yield pd.DataFrame([stored(t, unit) for t in x], columns=["n_bytes", "blob"]).assign(declared=UNKNOWN)

    return docs.select(F.col(id_col), store(F.col(text_col)).alias("s")).select(id_col, "s.n_bytes", "s.blob", "s.declared")


def wave_features(sniffed: DataFrame, blob_col: str = "blob") -> DataFrame:
    """``sniffed`` without its blob and with what is read back from stored WAVE files: ``payload_bytes``,
    ``payload_sha256``, ``tail_crc32`` (of the last 16 bytes), ``media_bytes``, ``media_sha256`` and ``feature``: type,
    channels, bits, rate, samples, mean, mean square and crossings of the middle, and the embedded media. Null and empty
    blobs, and other types, have the last three alone. Columns of the input with these names give way."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def read(parts: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for blobs, seen in parts:
            yield pd.DataFrame([read_wave(*x) for x in zip(blobs, seen["type"], seen["embedded"])], columns=FEATURES)

    f = fresh("f", sniffed.columns)
    out = sniffed.withColumn(f, read(F.col(blob_col), F.col("sniffed")))
    return out.select(*[F.col(c) for c in sniffed.columns if c != blob_col and c.lower() not in FEATURES], f"{f}.*")


def describe_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """id, ``n_bytes``, ``corrected_type`` and the columns of :func:`wave_features`: :func:`store_texts`, :func:`sniff` and
    :func:`wave_features` in one pass over the texts, so that stored files stay in the task that made them."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            out = []
            for i, text in zip(x["id"], x["text"]):
                n, blob = stored(text, unit)
                seen = looked(blob, UNKNOWN)
                out.append((i, n, seen[2], *read_wave(blob, seen[0], seen[4])))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "corrected_type", *FEATURES])

    schema = "id string, n_bytes long, corrected_type string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    out = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
    return out.select(F.col("id").cast(kind).alias(id_col), *out.columns[1:])
