import gzip
import hashlib
import io
import struct
import zipfile
import zlib

import pytest

from loomgraph.llm import media as M

PNG = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"\0ab\0cd")), (b"IEND", b"")))
GIF = b"GIF89a\x01\0\x01\0\x80\0\0" + b"\0" * 6 + b"!\xf9\x04\0\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x05abc\xff\xda\0\x03a" + b"data\xff\0more" + b"\xff\xd9"
PDF = b"%PDF-1.4\nstuff xref\n0 1\nstartxref\n15\n%%EOF"


def page(body):
    """An Ogg page, its checksum by long division."""
    head, crc = b"OggS\0\x06" + bytes(16), 0
    for x in head + bytes(4) + bytes([1, len(body)]) + body:
        crc ^= x << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x104C11DB7 if crc & 0x80000000 else 0)
    return head + struct.pack("<I", crc) + bytes([1, len(body)]) + body


OGG = page(b"abc")
MP4 = struct.pack(">I", 12) + b"ftypisom" + struct.pack(">I", 8) + b"moov"


def zipped() -> bytes:
    with zipfile.ZipFile(f := io.BytesIO(), "w") as z:
        z.writestr("a", "b" * 50)
    return f.getvalue()


ALL = {"image/png": PNG, "image/gif": GIF, "image/jpeg": JPEG, "application/pdf": PDF, "audio/ogg": OGG, "video/mp4": MP4, "application/zip": zipped(), "application/gzip": gzip.compress(b"hello" * 20), M.WAV: M.encode(b"abc", M.WAV), M.BMP: M.encode(b"x" * 576, M.BMP), M.PGM: M.encode(b"x" * 576, M.PGM)}


@pytest.mark.parametrize("kind", ALL)
def test_found_whole_embedded_and_not_when_broken(kind):
    b = ALL[kind]
    assert M.objects(b)[0] == (0, len(b), kind)
    assert (5, len(b), kind) in M.objects(b"junk!" + b + b"tail")
    assert not [o for o in M.objects(b[:-2]) if o[2] == kind]


def test_what_is_written_must_hold():
    assert not M.objects(PDF.replace(b"15", b"14")) and not M.objects(PDF.replace(b"15", b"99")) and not M.objects(OGG[:-1] + b"d")
    linear = b"%PDF-1.4\nstartxref\n0\n%%EOF\nxref\n0 1\nstartxref\n27\n%%EOF"
    assert M.objects(linear) == [(0, len(linear), "application/pdf")]


def test_many_false_starts():
    """Linear in the length: half a megabyte of magic bytes without what should follow."""
    import time

    began = time.time()
    for junk in (b"%PDF-1.", b"%PDF-1.4 startxref ", b"PK\x03\x04", b"PK\x03\x04PK\x05\x06" + bytes(18), b"OggS\0", b"\x1f\x8b\x08\x00"):
        assert M.objects(junk * ((1 << 19) // len(junk))) == []
    assert time.time() - began < 30


@pytest.mark.parametrize("kind", [M.WAV, M.BMP, M.PGM])
def test_samples_are_lossless(kind):
    p = bytes(range(256)) * 9
    assert M.decode(M.encode(p, kind))[0::2] == (kind, p)


def test_sniff_and_carve(spark):
    rows = [(1, b"junk" + PNG + b"x" + GIF, "text/plain", "e"), (2, PNG, "image/jpeg", None), (3, None, "image/png", "e"), (4, b"", None, "e"), (5, M.encode(PNG + b"\0" * (576 - len(PNG)), M.PGM), M.PGM, "e"), (5, b"BM RIFF P5 %PDF-", None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, blob binary, said string, type2 string")
    s = M.sniff(df, "blob", "said")
    got = {(r.doc_id, r.media_type, r.media_length, r.corrected, len(r.embedded)) for r in s.collect()}
    assert got == {(1, M.UNKNOWN, 0, False, 2), (2, "image/png", len(PNG), True, 0), (3, None, 0, False, 0), (4, M.UNKNOWN, 0, False, 0), (5, M.PGM, len(M.encode(b"\0" * 576, M.PGM)), False, 1), (5, M.UNKNOWN, 0, False, 0)}
    parts = M.carve(s, "blob").collect()
    assert sorted((r.doc_id, bytes(r.bytes)) for r in parts) == sorted([(1, PNG), (1, GIF), (5, PNG)])


def kind_of(text):
    return (M.WAV, M.BMP, M.PGM)[zlib.crc32(text) % 3]


def brute_feature(text, payload):
    """From the payload's bytes one by one, and every place of the file looked at."""
    kind, rows = kind_of(text), len(payload) // 576
    bins = [sum(1 for x in payload if x // 32 == k) for k in range(8)]
    media, inside, upto = M.encode(payload, kind), [], 1
    for at in range(1, len(media)):
        for magic, (check, back) in M.MAGIC.items():
            if at >= upto and media[at + back : at + back + len(magic)] == magic and (found := check(media, at)):
                inside.append(f"{found[0]}@{at}+{found[1]}")
                upto = at + found[1]
    shape = f"{len(payload)}@8000" if kind == M.WAV else f"576x{rows}"
    return f"{kind};{shape};sum={sum(payload)};bins={'/'.join(map(str, bins))};inside={','.join(inside)}"


def test_store_round_trip(spark):
    texts = [None, "", "a", "é" * 300, "x" * 576, "y" * 577, "BM P5 RIFF " * 4000, "a", "P5 2 2 255 abcd and P6 1 1 255\nabc"]
    df = spark.createDataFrame([(i if i else None, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in M.features(M.store(df)).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
        r = got[i or None]
        assert r.feature == brute_feature(b, p) and (r.media_bytes, r.media_sha256) == (len(m := M.encode(p, kind_of(b))), hashlib.sha256(m).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[2][1:] == got[7][1:]
    assert M.features(M.store(df.limit(0))).count() == 0
