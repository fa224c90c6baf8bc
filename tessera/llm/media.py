"""Media columns: signature sniffing, structural validation and carving.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass. Each hit is only a candidate; the
format's validator must confirm the structure and give the exact length. A hit at offset 0 that spans the value names
its true type, whatever type was declared; validated hits elsewhere are embedded media and are carved out.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import id_text, load, materialize, texts_of

RATE = 8000


# Containers that hold 8-bit samples as they are.


def wav(samples: bytes) -> bytes:
    """RIFF/WAVE, mono, unsigned 8-bit samples."""
    odd = b"\0" * (len(samples) & 1)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + odd
    return b"RIFF" + struct.pack("<I", len(body)) + body


def pgm(samples: bytes, width: int = 64) -> bytes:
    """Binary greyscale map of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def bmp(samples: bytes, width: int = 64) -> bytes:
    """Windows bitmap with a grey palette of 256; the rows as given, bottom first."""
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    at = 14 + 40 + 1024
    head = b"BM" + struct.pack("<IHHI", at + len(samples), 0, 0, at)
    return head + struct.pack("<IiiHHIIiiII", 40, width, len(samples) // width, 1, 8, 0, len(samples), 2835, 2835, 256, 0) + palette.tobytes() + samples


# Validators: (end, payload start, payload end, detail) of a structure that begins at `at`, or None.

Found = tuple[int, int, int, str]


class Marks:
    """Closing marks of a value, found once for all hits in it."""

    def __init__(self, value: bytes):
        self.value = value

    @cached_property
    def archives(self) -> dict[int, int]:
        """Start of each archive, as its end record tells, with the place of the first such record."""
        b, out = self.value, {}
        end = b.find(b"PK\5\6")
        while end >= 0 and end + 22 <= len(b):
            n, size, offset, comment = struct.unpack_from("<HIIH", b, end + 10)
            at = end - size - offset
            if at >= 0 and end + 22 + comment <= len(b) and (not n or b[at + offset : at + offset + 4] == b"PK\1\2"):
                out.setdefault(at, end)
            end = b.find(b"PK\5\6", end + 4)
        return out

    def _all(self, mark: bytes) -> list[int]:
        return [m.start() for m in re.finditer(re.escape(mark), self.value)]

    @cached_property
    def tables(self) -> list[int]:
        return self._all(b"startxref")

    @cached_property
    def ends(self) -> list[int]:
        return self._all(b"%%EOF")

    @cached_property
    def segments(self) -> list[int]:
        """Where picture data of a JPEG stop: at any marker but stuffing and restarts."""
        return [m.start() for m in re.finditer(rb"\xff(?=[\x01-\xcf\xd8-\xfe])", self.value)]


def after(places: list[int], at: int) -> int:
    """The first of some ascending places from `at` on, or -1."""
    k = bisect_left(places, at)
    return places[k] if k < len(places) else -1


def _riff(b: bytes, at: int, marks: Marks) -> Found | None:
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return None
    pos, form, data = at + 12, None, None
    while pos + 8 <= end:
        name, size = b[pos : pos + 4], int.from_bytes(b[pos + 4 : pos + 8], "little")
        if pos + 8 + size > end:
            return None
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", b, pos + 8)
        elif name == b"data":
            data = (pos + 8, pos + 8 + size)
        pos += 8 + size + (size & 1)
    if form is None or data is None or pos not in (end, end + 1):
        return None
    kind, channels, rate, per_s, align, bits = form
    if kind != 1 or not channels or bits % 8 or align != channels * bits // 8 or per_s != rate * align:
        return None
    return end, *data, f"{rate}Hz,{channels}ch,{bits}bit"


def _pgm(b: bytes, at: int, marks: Marks) -> Found | None:
    numbers, pos = [], at + 2
    for _ in range(3):
        begin = pos
        while pos < len(b) and b[pos] in b" \t\r\n" and pos - begin < 8:
            pos += 1
        start = pos
        while pos < len(b) and 48 <= b[pos] <= 57 and pos - start < 10:
            pos += 1
        if start == begin or pos == start:
            return None
        numbers.append(int(b[start:pos]))
    width, height, top = numbers
    if pos >= len(b) or b[pos] not in b" \t\r\n" or not width or not height or not 0 < top < 256:
        return None
    end = pos + 1 + width * height
    return (end, pos + 1, end, f"{width}x{height}") if end <= len(b) else None


def _bmp(b: bytes, at: int, marks: Marks) -> Found | None:
    if len(b) < at + 54:
        return None
    size, r1, r2, offset = struct.unpack_from("<IHHI", b, at + 2)
    head, width, height, planes, bits, packed, _ = struct.unpack_from("<IiiHHII", b, at + 14)
    if r1 or r2 or head not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 24, 32) or packed or width <= 0 or not height:
        return None
    need = offset + (width * bits + 31) // 32 * 4 * abs(height)
    if offset < 14 + head or size < need or at + size > len(b):
        return None
    return at + size, at + offset, at + need, f"{width}x{abs(height)},{bits}bit"


def _png(b: bytes, at: int, marks: Marks) -> Found | None:
    pos, detail, first = at + 8, "", True
    while pos + 12 <= len(b):
        size, name = int.from_bytes(b[pos : pos + 4], "big"), b[pos + 4 : pos + 8]
        if pos + 12 + size > len(b) or zlib.crc32(b[pos + 4 : pos + 8 + size]) != int.from_bytes(b[pos + 8 + size : pos + 12 + size], "big"):
            return None
        if first:
            if name != b"IHDR" or size != 13:
                return None
            detail, first = "{}x{}".format(*struct.unpack_from(">II", b, pos + 8)), False
        pos += 12 + size
        if name == b"IEND":
            return pos, at, pos, detail
    return None


def _gif(b: bytes, at: int, marks: Marks) -> Found | None:
    if len(b) < at + 13:
        return None
    width, height, flags = struct.unpack_from("<HHB", b, at + 6)
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)

    def blocks(pos: int) -> int:
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        return pos + 1

    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1, at, pos + 1, f"{width}x{height}"
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 <= len(b):
            local = b[pos + 9]
            pos = blocks(pos + 11 + (3 << (local & 7) + 1 if local & 128 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int, marks: Marks) -> Found | None:
    pos, detail = at + 2, ""
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        mark = b[pos + 1]
        if mark == 0xFF:
            pos += 1
            continue
        size = int.from_bytes(b[pos + 2 : pos + 4], "big")
        if size < 2 or mark < 0xC0:
            return None
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and pos + 9 <= len(b):
            height, width = struct.unpack_from(">HH", b, pos + 5)
            detail = f"{width}x{height}"
        pos += 2 + size
        if mark == 0xDA:
            if (pos := after(marks.segments, pos)) < 0:
                return None
            if b[pos + 1] == 0xD9:
                return (pos + 2, at, pos + 2, detail) if detail else None
    return None


def _zip(b: bytes, at: int, marks: Marks) -> Found | None:
    if (end := marks.archives.get(at, -1)) < at:
        return None
    n, comment = struct.unpack_from("<H", b, end + 10)[0], struct.unpack_from("<H", b, end + 20)[0]
    return end + 22 + comment, at, end + 22 + comment, f"{n}files"


def _pdf(b: bytes, at: int, marks: Marks) -> Found | None:
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b"." or (x := after(marks.tables, at)) < 0 or (end := after(marks.ends, x)) < 0:
        return None
    return end + 5, at, end + 5, b[at + 5 : at + 8].decode("latin-1")


FORMATS: dict[str, tuple[tuple[bytes, ...], Callable[[bytes, int, Marks], Found | None]]] = {
    "wav": ((b"RIFF",), _riff), "pgm": ((b"P5\n", b"P5 ", b"P5\t", b"P5\r"), _pgm), "bmp": ((b"BM",), _bmp), "png": ((b"\x89PNG\r\n\x1a\n",), _png),
    "gif": ((b"GIF87a", b"GIF89a"), _gif), "jpeg": ((b"\xff\xd8\xff",), _jpeg), "zip": ((b"PK\3\4",), _zip), "pdf": ((b"%PDF-",), _pdf),
}


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, (magics, _) in FORMATS.items():
        for m in magics:
            out.add_word(m.decode("latin-1"), (len(m), kind))
    out.make_automaton()
    return out


MAGIC = _automaton()


def sniff(value: bytes) -> list[tuple[int, str, Found]]:
    """(start, kind, found) of every confirmed structure, by start; within one, its embedded media follow."""
    out, marks = [], Marks(value)
    for last, (size, kind) in MAGIC.iter(value.decode("latin-1")):
        at = last - size + 1
        if found := FORMATS[kind][1](value, at, marks):
            out.append((at, kind, found))
    return sorted(out)


def true_type(value: bytes, declared: str | None) -> tuple[str, bool]:
    """The type of the structure that begins the value and ends with it (else the declared one), and if it was confirmed."""
    for at, kind, found in sniff(value):
        if at == 0 and found[0] == len(value):
            return kind, True
    return declared or "unknown", False


def carve(value: bytes) -> list[tuple[str, int, bytes]]:
    """(kind, start, bytes) of embedded media: confirmed structures that don't begin the value, outermost first."""
    out, done = [], 0
    for at, kind, found in sniff(value):
        if at and at >= done:
            out.append((kind, at, value[at : found[0]]))
            done = found[0]
    return out


def stored_form(payload: bytes) -> bytes:
    """The payload as 8-bit samples of a container that its own checksum picks."""
    return (wav, pgm, bmp)[zlib.crc32(payload) % 3](payload)


def padded(text: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))


def describe(value: bytes) -> tuple[str, bytes]:
    """The feature string of a stored value and the payload that its outer structure carries."""
    found = sniff(value)
    kind, (_, a, b, detail) = next((k, f) for at, k, f in found if at == 0 and f[0] == len(value))
    payload = value[a:b]
    x = np.frombuffer(payload, np.uint8)
    hist = np.bincount(x, minlength=256)
    p = hist[hist > 0] / len(x)
    inner = [f"{k}:{at}:{f[0]}" for at, k, f in found if at]
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    said = f"{kind};{detail};sum={int(x.sum(dtype=np.int64))};entropy={-(p * np.log2(p)).sum():.4f};crossings={crossings};embedded={','.join(inner)}"
    return said, payload


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media table: doc_id, declared type (one of the three, whatever the value is), n_bytes of the text, and the stored bytes."""
    rows = id_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = texts_of(part.column(1))
                media = [stored_form(padded(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([("wav", "pgm", "bmp")[zlib.crc32(t) // 3 % 3] for t in texts], pa.string()), pa.array([len(t) for t in texts]), pa.array(media, pa.binary())], ["doc_id", "declared", "n_bytes", "media"])

    return rows.mapInArrow(run, f"doc_id {kind}, declared string, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, sniffed, corrected."""
    kind = dict(media.dtypes)["doc_id"]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "sniffed", "corrected"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, declared in zip(batch.column("media"), batch.column("declared"), strict=True):
                value, declared = value.as_py(), declared.as_py()
                feature, payload = describe(value)
                sniffed = feature.partition(";")[0]
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(value), hashlib.sha256(value).hexdigest(), feature, sniffed, declared != sniffed))
            cols = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, sniffed string, corrected boolean")


def sniffed_types(table: DataFrame, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """For a table with media of its own: all its columns and __media (type, confirmed, carved list of kind, start, end).

    A null value has the declared type, unconfirmed, and nothing carved.
    """

    @F.pandas_udf("type string, confirmed boolean, carved array<struct<kind:string,start:long,end:long>>")
    def run(values, declared):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for v, d in zip(values, declared, strict=True):
            v = bytes(v) if v is not None else b""
            out.append((*true_type(v, d), [(k, at, at + len(x)) for k, at, x in carve(v)]))
        return pd.DataFrame(out, columns=["type", "confirmed", "carved"])

    return table.withColumn("__media", run(F.col(media_col), F.col(declared_col)))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are 64 zero bytes; repeated rows are kept; an empty table gives an empty result."""
    return features(materialize(stored(load(spark, sf_dir, "documents")), "media"))
