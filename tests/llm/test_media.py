import hashlib
import io
import struct
import time
import wave
import zipfile
import zlib

import pytest

from tessera.llm import media as M


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\x05")) + chunk(b"IEND", b"")
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0" + b"\xff\xc0\0\x0b\x08\0\2\0\3\1\1\x11\0" + b"\xff\xda\0\x08\1\1\0\0\x3f\0abc\xff\0d\xff\xd9"
PDF = b"%PDF-1.4\nx\nstartxref\n9\n%%EOF"


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


@pytest.mark.parametrize("kind, value", [("png", PNG), ("gif", GIF), ("jpeg", JPEG), ("pdf", PDF), ("zip", archive()), ("wav", M.wav(b"x" * 65)), ("pgm", M.pgm(b"x" * 64)), ("bmp", M.bmp(b"x" * 128))])
def test_types_are_corrected_carved_and_checked(kind, value):
    assert M.true_type(value, "text/plain") == (kind, True)
    assert M.carve(b"BM RIFF noise " + value + b"GIF89a tail")[0] == (kind, 14, value)
    assert M.true_type(value[:-1], "text/plain") == ("text/plain", False)


@pytest.mark.parametrize("piece", [b"%PDF-1.", b"PK\3\4", b"PK\5\6" + b"\0" * 18, b"\xff\xd8\xff\xda\0\2a", b"BM", b"P5 1 1 255 ", b"startxref", b"%%EOF", b"%PDF-1.startxref"])
def test_many_marks_take_linear_time(piece):
    began = time.time()
    M.sniff(piece * (2_000_000 // len(piece)))
    assert time.time() - began < 20


def test_declared_types_are_corrected(spark):
    df = spark.createDataFrame([(k, f"text {k}") for k in range(60)], "doc_id long, text string")
    media = M.materialize(M.stored(df), "t")
    declared = {r.doc_id: r.declared for r in media.collect()}
    rows = M.features(media).collect()
    assert {r.corrected for r in rows} == {True, False} and all(r.corrected == (r.sniffed != declared[r.doc_id]) for r in rows)


def test_wave_reads_elsewhere():
    with wave.open(io.BytesIO(M.wav(bytes(range(64))))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(99)) == (1, 1, bytes(range(64)))


def test_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(900, None), (901, ""), (None, "BM P5\n8 8\n255\n" + "y" * 90), (902, ""), (903, "é" * 32), (904, "RIFF\0" + "z" * 200_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_bytes int, media string")
    got = M.features(M.materialize(M.stored(df), "t")).collect()
    by = {r.doc_id: r for r in got}
    for doc, text in rows:
        raw = (text or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = by[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert r.media_sha256 == hashlib.sha256(M.stored_form(want)).hexdigest() and r.media_bytes == len(M.stored_form(want))
    assert "pgm:" in by[None].feature and by[900].feature == by[901].feature
    assert M.features(M.materialize(M.stored(df.limit(0)), "t")).count() == 0


def test_own_media_table(spark):
    df = spark.createDataFrame([(1, PNG, "image/gif"), (2, None, None), (3, b"text" + GIF, "text")], "id int, media binary, declared string")
    got = {r.id: r["__media"] for r in M.sniffed_types(df).collect()}
    assert got[1].type == "png" and got[2].type == "unknown" and not got[2].confirmed
    assert [(c.kind, c.start) for c in got[3].carved] == [("gif", 4)]
