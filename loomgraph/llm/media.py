"""Media columns: signatures are sniffed, structure is confirmed, declared types are corrected, embedded media is carved.

One Aho-Corasick automaton finds all magic bytes of a binary value in one pass; at each place the format's validator walks
the structure (chunks, segments, boxes, checksums, sizes) and says how long the object is, or that it is none. The object at 0
gives the value's type; others are embedded: an object within another embedded one isn't reported apart.

``encode``/``decode`` hold 8-bit samples losslessly as WAV (PCM, mono), BMP (grey palette) or PGM.

Cases: a null value has null type, length 0 and nothing embedded; an empty or unknown value has type
``application/octet-stream``; a null declared type counts as wrong when the type is known; where objects overlap the first one
counts, and no two kinds begin alike; very long values are
read whole, in one task each; equal rows give equal results; other columns stay (a result's name among them is refused);
``store`` takes doc_id and text and ignores the rest, null text being empty; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

UNKNOWN = "application/octet-stream"
BLOCK = 576

# Validators: (bytes, place) -> (type, length) or None ------------------------------------------------------------------


def _png(b: bytes, at: int):
    i, first = at + 8, True
    while i + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13) or zlib.crc32(memoryview(b)[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return None
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return "image/png", i - at
    return None


def _jpeg(b: bytes, at: int):
    i, frame = at + 2, False
    while i + 4 <= len(b) and b[i] == 0xFF:
        m = b[i + 1]
        if m == 0xFF:
            i += 1
            continue
        n = struct.unpack_from(">H", b, i + 2)[0]
        if m in (0x00, 0x01, 0xD8, 0xD9) or 0xD0 <= m <= 0xD7 or n < 2 or i + 2 + n > len(b):
            return None
        frame |= 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC)
        i += 2 + n
        if m == 0xDA:  # entropy-coded data, up to the next marker that is no restart
            while True:
                i = b.find(b"\xff", i)
                if i < 0 or i + 1 >= len(b):
                    return None
                if b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7:
                    i += 2
                else:
                    break
            if b[i + 1] == 0xD9:
                return ("image/jpeg", i + 2 - at) if frame else None
    return None


def _gif(b: bytes, at: int):
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    i = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(i: int) -> int:
        while i < len(b) and b[i]:
            i += 1 + b[i]
        return i + 1

    while i < len(b):
        if b[i] == 0x3B:
            return "image/gif", i + 1 - at
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 <= len(b):
            local = b[i + 9]
            i = blocks(i + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            return None
    return None


_RIFF = {b"WAVE": ("audio/wav", {b"fmt ", b"data"}), b"WEBP": ("image/webp", set()), b"AVI ": ("video/x-msvideo", {b"LIST"})}


def _riff(b: bytes, at: int):
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    end = at + 8 + size
    if form not in _RIFF or end > len(b) or size < 4:
        return None
    kind, need = _RIFF[form]
    i, seen = at + 12, set()
    while i + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, i)
        seen.add(name)
        i += 8 + n + (n & 1)
    return (kind, end + (size & 1 and end < len(b) and 0) - at) if i in (end, end + 1) and seen and need <= seen else None


def _bmp(b: bytes, at: int):
    if at + 54 > len(b):
        return None
    size, _, off, head, w, h, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or head not in (40, 52, 56, 108, 124) or w <= 0 or h == 0 or at + size > len(b) or off < 14 + head:
        return None
    row = (w * bits + 31) // 32 * 4
    return ("image/bmp", size) if packed == 0 and off + row * abs(h) == size else None


def _pnm(b: bytes, at: int):
    fields, i = [], at + 2
    while len(fields) < 3:
        start = i
        while i < len(b) and i - start < 64 and b[i] in b" \t\r\n":
            i += 1
        j = i
        while j < len(b) and j - i < 10 and 48 <= b[j] <= 57:
            j += 1
        if i == start or j == i:
            return None
        fields.append(int(b[i:j]))
        i = j
    w, h, most = fields
    if i >= len(b) or b[i] not in b" \t\r\n" or not (w and h and 0 < most < 65536):
        return None
    length = i + 1 - at + w * h * (3 if b[at + 1] == 54 else 1) * (1 if most < 256 else 2)
    return (("image/x-portable-pixmap" if b[at + 1] == 54 else "image/x-portable-graymap"), length) if at + length <= len(b) else None


def _gzip(b: bytes, at: int):
    if b[at + 3 : at + 4] > b"\x1f":
        return None
    d = zlib.decompressobj(31)
    try:
        i, step = at, 1 << 16
        while i < len(b) and not d.eof:
            d.decompress(b[i : i + step])
            i += step
    except zlib.error:
        return None
    return ("application/gzip", min(i, len(b)) - len(d.unused_data) - at) if d.eof else None


def _zip(b: bytes, at: int):
    end = _zip_ends(b).get(at)
    if end is None:
        return None
    n = struct.unpack_from("<H", b, end + 20)[0]
    return ("application/zip", end + 22 + n - at) if end + 22 + n <= len(b) else None


@lru_cache(maxsize=1)
def _zip_ends(b: bytes) -> dict[int, int]:
    """For each place where an end record says that an archive begins, the first such record's place: all in one pass."""
    out: dict[int, int] = {}
    i = -1
    while (i := b.find(b"PK\x05\x06", i + 1)) >= 0 and i + 22 <= len(b):
        size, off = struct.unpack_from("<II", b, i + 12)
        if (start := i - size - off) >= 0 and b[start + off : start + off + 4] == b"PK\x01\x02":
            out.setdefault(start, i)
    return out


@lru_cache(maxsize=2)
def _places(b: bytes, what: bytes) -> list[int]:
    out, i = [], -1
    while (i := b.find(what, i + 1)) >= 0:
        out.append(i)
    return out


_XREF = re.compile(rb"startxref\s{1,4}(\d{1,10})\s{1,4}%%EOF")
_TABLE = re.compile(rb"xref|\d{1,10}\s{1,4}\d{1,5}\s{1,4}obj")


def _pdf(b: bytes, at: int):
    """Up to the first end mark whose ``startxref`` leads to a cross-reference table or stream (a linearised file's first says 0)."""
    if not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"."):
        return None
    found = _places(b, b"startxref")
    for i in found[(k := bisect.bisect_left(found, at)) : k + 2]:
        if (m := _XREF.match(b, i)) is None:
            return None
        if off := int(m[1]):
            return ("application/pdf", m.end() - at) if at + off < i and _TABLE.match(b, at + off) else None
    return None


_TURNED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _ogg_crc(page: bytes) -> int:
    """CRC-32 of the same polynomial as zlib's, but from the high bits on, and from 0."""
    raw = zlib.crc32(page.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{raw:032b}"[::-1], 2)


def _ogg(b: bytes, at: int):
    i = at
    while b[i : i + 4] == b"OggS" and i + 27 <= len(b) and b[i + 4] == 0:
        n = b[i + 26]
        end = i + 27 + n + sum(b[i + 27 : i + 27 + n])
        if end > len(b) or _ogg_crc(b[i : i + 22] + bytes(4) + b[i + 26 : end]) != struct.unpack_from("<I", b, i + 22)[0]:
            return None
        last, i = b[i + 5] & 4, end
        if last:
            return "audio/ogg", i - at
    return None


def _mp4(b: bytes, at: int):
    i, seen = at, set()
    while i + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if n < 8 or i + n > len(b) or not kind.isalnum():
            break
        seen.add(kind)
        i += n
    return ("video/mp4", i - at) if {b"ftyp", b"moov"} <= seen else None


MAGIC = {
    b"\x89PNG\r\n\x1a\n": (_png, 0), b"\xff\xd8\xff": (_jpeg, 0), b"GIF87a": (_gif, 0), b"GIF89a": (_gif, 0), b"RIFF": (_riff, 0), b"BM": (_bmp, 0), b"P5": (_pnm, 0), b"P6": (_pnm, 0),
    b"\x1f\x8b\x08": (_gzip, 0), b"PK\x03\x04": (_zip, 0), b"%PDF-": (_pdf, 0), b"OggS": (_ogg, 0), b"ftyp": (_mp4, 4),
}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for m, (check, back) in MAGIC.items():
        a.add_word(m.decode("latin-1"), (len(m), check, back))
    a.make_automaton()
    return a


def objects(b: bytes) -> list[tuple[int, int, str]]:
    """(place, length, type) of the object at 0, if there is one, and of all embedded in what it or the value holds."""
    starts = [(end + 1 - n - back, check) for end, (n, check, back) in _automaton().iter(b.decode("latin-1")) if end + 1 - n - back >= 0]
    out, upto = [], 0
    for at, check in sorted(starts, key=lambda x: x[0]):
        if at < upto and at > 0:
            continue
        if found := check(b, at):
            out.append((at, found[1], found[0]))
            upto = at + found[1] if at else 0
    return out


# 8-bit samples ------------------------------------------------------------------------------------------------------------

WAV, BMP, PGM = "audio/wav", "image/bmp", "image/x-portable-graymap"
_GREYS = b"".join(bytes((i, i, i, 0)) for i in range(256))


def encode(payload: bytes, kind: str, width: int = BLOCK) -> bytes:
    """Samples as a media file; images have rows of ``width``, which must divide the payload and be a multiple of 4."""
    n = len(payload)
    if kind == WAV:
        pad = b"\0" * (n & 1)
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + len(pad), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload + pad
    if n % width or width % 4:
        raise ValueError("the payload doesn't fill its rows")
    if kind == BMP:
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 1078 + n, 0, 1078, 40, width, -(n // width), 1, 8, 0, n, 2835, 2835, 256, 0) + _GREYS + payload
    if kind == PGM:
        return b"P5\n%d %d\n255\n" % (width, n // width) + payload
    raise ValueError(kind)


def decode(media: bytes) -> tuple[str, str, bytes]:
    """Type, shape and samples of a file that ``encode`` made, or another of that kind."""
    if (found := next((o for o in objects_at_start(media)), None)) is None:
        return UNKNOWN, "", b""
    kind = found[0]
    if kind == WAV:
        i = 12
        while media[i : i + 4] != b"data":
            i += 8 + struct.unpack_from("<I", media, i + 4)[0]
        n, rate = struct.unpack_from("<I", media, i + 4)[0], struct.unpack_from("<I", media, 24)[0]
        return kind, f"{n}@{rate}", media[i + 8 : i + 8 + n]
    if kind == BMP:
        off, w, h = (struct.unpack_from(f, media, i)[0] for f, i in (("<I", 10), ("<i", 18), ("<i", 22)))
        rows = media[off : off + w * abs(h)] if w % 4 == 0 else b"".join(media[off + k * (w + -w % 4) :][:w] for k in range(abs(h)))
        return kind, f"{w}x{abs(h)}", rows if h < 0 else b"".join(rows[k * w : (k + 1) * w] for k in range(h - 1, -1, -1))
    if kind == PGM:
        head = media.split(None, 4)[:4]
        w, h = int(head[1]), int(head[2])
        return kind, f"{w}x{h}", media[found[1] - w * h : found[1]]
    return kind, "", b""


def objects_at_start(b: bytes) -> list[tuple[str, int]]:
    return [found for m, (check, back) in MAGIC.items() if b.startswith(m, back) and (found := check(b, 0))]


def _slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of that column, so that what is made from them stays small."""
    start = total = 0
    for i, v in enumerate(batch.column(column)):
        n = v.as_buffer().size if v.is_valid else 0
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def sniff(df: DataFrame, column: str, declared: str) -> DataFrame:
    """``df`` with media_type, media_length, corrected and embedded (place, length, type)."""
    add = T.StructType().add("media_type", "string").add("media_length", "long").add("corrected", "boolean")
    add = add.add("embedded", T.ArrayType(T.StructType().add("place", "long").add("length", "long").add("type", "string")))
    if clash := set(add.fieldNames()) & set(df.columns):
        raise ValueError(f"there are columns {sorted(clash)} already")
    kinds = pa.list_(pa.struct([("place", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, column):
                kind, length, wrong, inside = [], [], [], []
                for b, said in zip(batch.column(column).to_pylist(), batch.column(declared).to_pylist(), strict=True):
                    found = objects(b) if b else []
                    own = found[0] if found and found[0][0] == 0 else (0, 0, UNKNOWN)
                    kind.append(None if b is None else own[2])
                    length.append(own[1])
                    wrong.append(own[1] > 0 and own[2] != said)
                    inside.append([{"place": o[0], "length": o[1], "type": o[2]} for o in found if o[0] > 0])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind, pa.string()), pa.array(length, pa.int64()), pa.array(wrong, pa.bool_()), pa.array(inside, kinds)], names=[*batch.schema.names, *add.fieldNames()])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *add.fields]))


def carve(sniffed: DataFrame, column: str) -> DataFrame:
    """A row for each embedded object of a table from ``sniff``: its other columns, place, length, type and bytes."""
    keep = ", ".join(f"`{c}`" for c in sniffed.columns if c not in (column, "embedded"))
    return sniffed.selectExpr(keep.split(", ")[0], *keep.split(", ")[1:], f"`{column}` as __bytes", "inline(embedded)").selectExpr("* except (__bytes)", "substring(__bytes, cast(place + 1 as int), cast(length as int)) as bytes")


# The store of texts as media --------------------------------------------------------------------------------------------------

STORED = "doc_id long, n_bytes long, declared string, media binary"


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * ((-len(text)) % BLOCK or (0 if text else BLOCK))


def store(docs: DataFrame) -> DataFrame:
    """STORED: each text's payload as a WAV, BMP or PGM file by its checksum; what is declared is right for a third of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (WAV, BMP, PGM)
        for whole in batches:
            for batch in _slices(whole, "text"):
                texts = [t or b"" for t in batch.column("text").to_pylist()]
                media, said = [], []
                for t in texts:
                    c = zlib.crc32(t)
                    media.append(encode(payload_of(t), kinds[c % 3]))
                    said.append(kinds[c // 3 % 3])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(said), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text").mapInArrow(run, STORED)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean"


def features(stored: DataFrame) -> DataFrame:
    """FEATURES of each stored file, from its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, said, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "declared", "media")), strict=True):
                found = objects(media)
                kind, shape, payload = decode(media)
                x = np.frombuffer(payload, np.uint8)
                hist = np.bincount(x >> 5, minlength=8)
                inside = ",".join(f"{o[2]}@{o[0]}+{o[1]}" for o in found if o[0] > 0)
                feature = f"{kind};{shape};sum={int(x.sum(dtype=np.int64))};bins={'/'.join(map(str, hist.tolist()))};inside={inside}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, kind, kind != said))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], names=[f.split()[0] for f in FEATURES.split(", ")])

    return stored.mapInArrow(run, FEATURES)
