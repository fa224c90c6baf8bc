"""Token ids in binary form: static range asymmetric numeral system (rANS).

One frequency table, counted over all ids, serves every block. A block holds whole documents and is coded by itself:
token i of a block belongs to lane i mod LANES, all lanes advance together, and their 32-bit words are interleaved in
the order in which the decoder asks for them. Checkpoints keep the word position and all lane states every few steps:
a reader can start inside a block, and a whole block is decoded from all its checkpoints side by side, as one wider set
of lanes. A CRC-32 of the ids and one of the words guard it.

Block layout, little-endian: magic 'TRS1', u32 tokens, u32 lanes, u32 steps between checkpoints, u32 table id, u32
crc of ids, u32 words, u32 crc of words; lane states at the start, lanes x u64; for each checkpoint u32 word position
and lanes x u64 states; then the words, u32 each. Blocks are rows of a Parquet table, since any store that Spark can
write can hold them. The frequencies are one more row of it (part -1): magic 'TRT1', u32 ids, u32 crc, then a u32 for
each id. So the table is all that a reader needs.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tessera.llm.common import discard, id_text, load, materialize, text_buffers
from tessera.llm.kernel import Hasher, slices, word_bounds

BITS = 20  # frequencies sum to 2 ** BITS
LANES = 1024
STEPS = 512  # between checkpoints
BLOCK = 1 << 20  # a block ends with the first document that fills it
END_ID = 2
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4s7I")


class Table:
    """Quantised frequencies: every id that occurs keeps at least one slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.r_[0, np.cumsum(freq)].astype(np.uint64)[:-1]
        self.id = zlib.crc32(freq.astype("<u4").tobytes())
        self._slots = None

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        counts = counts.astype(np.int64)
        size = 1 << BITS
        seen = int((counts > 0).sum())
        if seen > size:
            raise ValueError("more distinct ids than slots")
        if not seen:
            return cls(np.zeros(len(counts), np.int64))
        freq = np.where(counts > 0, np.maximum(1, counts * ((size - seen) / counts.sum())).astype(np.int64), 0)
        rest = size - int(freq.sum())
        order = np.argsort(-counts, kind="stable")
        if rest > 0:
            freq[order[0]] += rest
        while rest < 0:
            room = np.minimum(freq[order] - 1, -rest)
            take = np.minimum(room, np.maximum(0, -rest - np.r_[0, np.cumsum(room)[:-1]]))
            freq[order] -= take
            rest += int(take.sum())
        return cls(freq)

    def to_bytes(self) -> bytes:
        return struct.pack("<4s2I", b"TRT1", len(self.freq), self.id) + self.freq.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        magic, n, crc = struct.unpack_from("<4s2I", raw)
        table = cls(np.frombuffer(raw, "<u4", offset=12)) if magic == b"TRT1" else None
        if table is None or len(table.freq) != n or table.id != crc:
            raise ValueError("not a table of frequencies, or a damaged one")
        return table

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = STEPS) -> bytes:
    n = len(ids)
    steps = -(-n // lanes)
    freq, cum = table.freq[ids], table.cum[ids]
    if n and not freq.all():
        raise ValueError("an id that the table doesn't have")
    state = np.full(lanes, LOW, np.uint64)
    bits, word = np.uint64(BITS), np.uint64(32)
    most = np.uint64(63 - BITS)
    parts: list[np.ndarray] = []
    marks: dict[int, np.ndarray] = {}
    for step in range(steps - 1, -1, -1):
        if (step + 1) % every == 0 and step + 1 < steps:
            marks[step + 1] = state.copy()
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[: b - a], freq[a:b]
        over = x >= (f << most)
        parts.append((x[over] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(over, x >> word, x)
        whole = x // f
        state[: b - a] = (whole << bits) + (x - whole * f) + cum[a:b]
    parts.reverse()
    sizes = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
    words = np.concatenate(parts).astype("<u4").tobytes() if parts else b""
    head = _HEAD.pack(b"TRS1", n, lanes, every, table.id, zlib.crc32(ids.astype("<u4").tobytes()), len(words) // 4, zlib.crc32(words))
    kept = b"".join(struct.pack("<I", sizes[s]) + marks[s].astype("<u8").tobytes() for s in sorted(marks))
    return head + state.astype("<u8").tobytes() + kept + words


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids [first, last) of a block; whole blocks are checked against both checksums."""
    magic, n, lanes, every, table_id, ids_crc, n_words, words_crc = _HEAD.unpack_from(block)
    if magic != b"TRS1" or table_id != table.id:
        raise ValueError("not a block of this table")
    last = n if last is None else min(last, n)
    first = min(first, last)
    steps = -(-n // lanes)
    marks = max(0, -(-steps // every) - 1)
    at = _HEAD.size + 8 * lanes
    words = np.frombuffer(block, "<u4", n_words, at + marks * (4 + 8 * lanes))
    if zlib.crc32(words.tobytes()) != words_crc:
        raise ValueError("damaged words")
    # One row of lanes for each checkpoint from the one before `first` to the one before `last`.
    mark, until = min(first // lanes // every, marks), min(max(0, last - 1) // lanes // every, marks)
    begin, end = mark * every, -(-last // lanes)
    state = np.empty((until - mark + 1, lanes), np.uint64)
    w = np.zeros(len(state), np.int64)
    for k in range(len(state)):
        if not (m := mark + k):
            state[k] = np.frombuffer(block, "<u8", lanes, at - 8 * lanes)
        else:
            w[k] = struct.unpack_from("<I", block, at + (m - 1) * (4 + 8 * lanes))[0]
            state[k] = np.frombuffer(block, "<u8", lanes, at + (m - 1) * (4 + 8 * lanes) + 4)
    out = np.empty(((end - begin), lanes), np.uint32) if end > begin else np.empty((0, lanes), np.uint32)
    mask, bits, word = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    slots, freq, cum = table.slots, table.freq, table.cum
    firsts = np.arange(len(state)) * every
    for step in range(min(every, end - begin)):
        live = int(np.searchsorted(firsts + step, end - begin))  # the last rows end first
        x = state[:live].ravel()
        tail = begin + firsts[live - 1] + step == steps - 1 and n % lanes
        if tail:
            x = x[: (live - 1) * lanes + tail]
        slot = x & mask
        ids = slots[slot.astype(np.int64)]
        x = freq[ids] * (x >> bits) + slot - cum[ids]
        low = np.flatnonzero(x < LOW)
        if len(low):
            own = low // lanes
            count = np.bincount(own, minlength=live)
            x[low] = (x[low] << word) | words[np.arange(len(low)) + (w[:live] - (np.cumsum(count) - count))[own]]
            w[:live] += count
        state[:live].reshape(-1)[: len(x)] = x
        flat = np.empty(live * lanes, np.uint32)
        flat[: len(ids)] = ids
        out[firsts[:live] + step] = flat.reshape(live, lanes)
    out = out.ravel()[: min(n, end * lanes) - begin * lanes] if end > begin else out.ravel()
    if first == 0 and last == n and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("damaged block")
    return out[first - begin * lanes : last - begin * lanes]


_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x0A]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_POINT = np.zeros(256, bool)
_POINT[[ord(c) for c in ".,;:!?"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 11, 12, 13, 28, 29, 30, 31]] = True


class UnitEncoder:
    """The tokenizers library's own ids, with the units of a text encoded once.

    A byte-level BPE pre-tokenizer keeps a space at the front of what follows it and a line end between other characters
    by itself. So a text can be cut at its line ends and before its spaces, and the ids of the parts joined are the ids
    of the whole, unless white space meets white space or begins or ends a text, or a special token occurs: such a text
    goes to the library as a whole. A point or comma behind a letter begins a unit too. Many texts are cut at once; their
    different units are found by hash and looked up. Of those not known yet, runs of letters are one pre-token and go to
    the library's model; all others are encoded many at a time, joined by line ends.
    """

    def __init__(self, path: str, most: int = 900_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.plain: dict[bytes, bytes] = {}  # units without a space in front
        self.spaced: dict[bytes, bytes] = {}  # units after a space, without it
        self.most = most
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_end = np.frombuffer(self.whole(b"\n"), self.kind)
        # The byte alphabet of such tokenizers: printable Latin-1 stands for itself, the other bytes follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        probes = ["hello", " hello", " \u00dcberzeugung", "\u4e2d\u6587", " \u00c0\u00ad\u00e0x"[:2]]
        self.direct = all(self._one(p.encode()) == self.whole(p.encode()) for p in probes)

    def _one(self, unit: bytes) -> bytes:
        """Ids of a unit that is one pre-token."""
        tokens = self.model.tokenize(unit.decode("latin-1").translate(self.letters))
        return array("H" if self.kind.itemsize == 2 else "I", [t.id for t in tokens]).tobytes()

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, fresh: list[bytes], known: dict[bytes, bytes], lead: bytes) -> None:
        mark, size, join = self.line_end, self.kind.itemsize, b"\n" + lead
        if self.direct:
            ask, code, front = self.model.tokenize, "H" if size == 2 else "I", lead.decode("latin-1").translate(self.letters)
            rest = []
            for u in fresh:
                if u.isalpha():  # ASCII letters stand for themselves
                    known[u] = array(code, [t.id for t in ask(front + u.decode())]).tobytes()
                elif not u.isascii() and u.decode("utf-8", "replace").isalpha():
                    known[u] = self._one(lead + u)
                else:
                    rest.append(u)
            fresh = rest
        groups = [fresh[k : k + 400] for k in range(0, len(fresh), 400)]
        for k in range(0, len(groups), 50):
            part = groups[k : k + 50]
            found = self.tokenizer.encode_batch_fast([(lead + join.join(g)).decode("utf-8", "replace") for g in part], add_special_tokens=False)
            for g, e in zip(part, found, strict=True):
                ids = np.array(e.ids, self.kind)
                marks = np.flatnonzero(ids == mark[0]) * size if len(mark) == 1 else ()
                if len(marks) != len(g) - 1:
                    known.update((u, self.whole(lead + u)) for u in g)
                    continue
                begins, ends = [0, *(marks + size).tolist()], [*marks.tolist(), len(ids) * size]
                known.update(zip(g, map(ids.tobytes().__getitem__, map(slice, begins, ends)), strict=True))

    def _odd(self, data: np.ndarray, offsets: np.ndarray, raw: bytes) -> np.ndarray:
        """Rows that must stay whole; too many does no harm."""
        n = len(data)
        cut = _CUT[data]
        at = np.zeros(n + 1, bool)
        inner = np.ones(n, bool)
        inner[offsets[:-1][offsets[:-1] < n]] = False  # not the first byte of a row
        at[1:n] = cut[1:] & cut[:-1] & inner[1:]
        at[:n] |= _BLANK[data]
        at[:n] |= cut & ~inner
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        at[offsets[full + 1] - 1] |= cut[offsets[full + 1] - 1]
        wide = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
        if len(wide):
            a, b, c = data[wide], data[np.minimum(wide + 1, n - 1)], data[np.minimum(wide + 2, n - 1)]
            hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
            hit |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
            at[wide[hit]] = True
        for s in self.special:
            k = raw.find(s)
            while k >= 0:
                at[k] = True
                k = raw.find(s, k + 1)
        rows = np.unique(np.searchsorted(offsets, np.flatnonzero(at), "right") - 1)
        return rows[(rows >= 0) & (rows < len(sizes))]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some rows of bytes, end_id after each row, and the bounds of the rows."""
        rows, raw = len(offsets) - 1, data.tobytes()
        s, e, row = word_bounds(data, offsets, _CUT)
        if len(data):
            points = np.flatnonzero(_POINT[data[1:]] & _LETTER[data[:-1]]) + 1
            points = points[~np.isin(points, offsets)]
            s, e = (np.sort(np.concatenate([x, points]), kind="stable") for x in (s, e))
            row = np.searchsorted(offsets, s, "right") - 1
        before = data[np.maximum(s - 1, 0)] if len(s) else s
        first = s == offsets[row]
        spaced, lined = ~first & (before == 0x20), ~first & (before == 0x0A)
        odd = self._odd(data, offsets, raw) if len(data) else np.empty(0, np.int64)
        if len(odd):
            keep = ~np.isin(row, odd)
            s, e, row, spaced, lined = s[keep], e[keep], row[keep], spaced[keep], lined[keep]
        hashes = Hasher(data)(s, e) ^ np.where(spaced, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.plain) + len(self.spaced) > self.most:
            self.plain.clear()
            self.spaced.clear()
        found: list[bytes] = []
        place = np.empty(len(at), np.int64)
        for known, lead, which in ((self.plain, b"", np.flatnonzero(~spaced[at])), (self.spaced, b" ", np.flatnonzero(spaced[at]))):
            place[which] = np.arange(len(found), len(found) + len(which))
            units = list(map(raw.__getitem__, map(slice, s[at[which]].tolist(), e[at[which]].tolist())))
            ids = list(map(known.get, units))
            if None in ids:
                self._learn([u for u, x in zip(units, ids, strict=True) if x is None], known, lead)
                ids = list(map(known.get, units))
            found += ids
        inverse = place[inverse]
        size = self.kind.itemsize
        length = np.array(list(map(len, found)), np.int64) // size
        pool = np.frombuffer(b"".join(found), self.kind)
        source = np.r_[0, np.cumsum(length)][:-1]
        mark = len(self.line_end)
        own = length[inverse]
        full = own + mark * lined
        per_row = np.bincount(row, full, rows).astype(np.int64) + 1
        whole = {int(r): np.frombuffer(self.whole(raw[offsets[r] : offsets[r + 1]]), self.kind) for r in odd}
        for r, ids in whole.items():
            per_row[r] = len(ids) + 1
        bounds = np.r_[0, np.cumsum(per_row)]
        out = np.empty(int(bounds[-1]), self.kind if end_id < 1 << 16 else "<u4")
        out[bounds[1:] - 1] = end_id
        ahead = np.cumsum(full) - full
        row_first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
        within = ahead - np.repeat(ahead[row_first], np.diff(np.r_[row_first, len(row)])) if len(row) else ahead
        dest = bounds[row] + within
        for k in range(mark):
            out[dest[lined] + k] = self.line_end[k]
        dest = dest + mark * lined
        total = int(own.sum())
        shift = np.cumsum(own) - own
        step = np.arange(total)
        out[step + np.repeat(dest - shift, own)] = pool[step + np.repeat(source[inverse] - shift, own)]
        for r, ids in whole.items():
            out[bounds[r] : bounds[r + 1] - 1] = ids
        return out, bounds


_encoders: dict[str, UnitEncoder] = {}


def _encoder(path: str) -> UnitEncoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """(doc_id, ids, counts), and the integer type of ids: their bytes, end_id last; a null text has the end id alone.

    Each task ends with a row without ids: its count of every id.
    """
    rows = id_text(docs, id_col, text_col)
    doc_kind = dict(rows.dtypes)["doc_id"]
    kind = _encoder(path).kind.str if end_id < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, width = _encoder(path), np.dtype(kind).itemsize
        total = np.zeros(end_id + 1, np.int64)
        doc_type = None
        for batch in batches:
            doc_type = batch.schema.field(0).type
            for lo, hi, data, at in slices(*text_buffers(batch.column(1)), 2 << 20):
                ids, bounds = coder.encode(data, at, end_id)
                counts = np.bincount(ids, minlength=len(total))
                counts[: len(total)] += total
                total = counts
                values = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), values, pa.nulls(hi - lo, pa.binary())], ["doc_id", "ids", "counts"])
        if doc_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, doc_type), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["doc_id", "ids", "counts"])

    return rows.mapInArrow(run, f"doc_id {doc_kind}, ids binary, counts binary"), kind


def shared_table(tokens: DataFrame) -> Table:
    """Counts of all ids; at most one row for each id of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                c = np.frombuffer(x.as_py(), "<i8")
                if len(c) > len(total):
                    total = np.pad(total, (0, len(c) - len(total)))
                total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = tokens.select("counts").filter("counts is not null").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in counts), default=-1) + 1, np.int64)
    for r in counts:
        out[r.id] = r.n
    return Table.of_counts(out)


BLOCK_SCHEMA = "part long, seq long, before long, n_docs long, n_tokens long, lengths binary, payload binary"


def write_blocks(tokens: DataFrame, table: Table, id_kind: str = "<u4", block: int = BLOCK) -> DataFrame:
    """Blocks in ascending order of doc_id and the table, written and reread; `before` counts the ids of a part ahead of a block."""
    kind = dict(tokens.dtypes)["doc_id"]
    width = int(id_kind[-1])
    ordered = tokens.filter("ids is not null").select("doc_id", "ids", F.xxhash64("ids").alias("h"))
    ordered = ordered.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "ids")
    freq = table.freq.astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Table(np.frombuffer(freq, "<u4"))
        part = TaskContext.get().partitionId()
        seq, before, size = 0, 0, 0
        ids: list[bytes] = []
        who: list = []

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(x) // width for x in ids], "<u4")
            payload = encode(np.frombuffer(b"".join(ids), id_kind).astype(np.uint32), shared)
            cols = [pa.array([v]) for v in (part, seq, before, len(ids), size)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([lengths.tobytes()], pa.binary()), pa.array([payload], pa.binary()), pa.array([who], pa.list_(doc_type))], names)

        names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")] + ["docs"]
        doc_type = pa.int64()
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                who.append(doc)
                ids.append(x)
                size += len(x) // width
                if size >= block:
                    yield flush()
                    seq, before, size, ids, who = seq + 1, before + size, 0, [], []
        if ids:
            yield flush()

    schema = f"{BLOCK_SCHEMA}, docs array<{kind}>"
    shared = tokens.sparkSession.createDataFrame([(-1, 0, 0, 0, 0, b"", table.to_bytes(), [])], schema)
    return materialize(ordered.mapInArrow(run, schema).union(shared), "blocks", "uncompressed")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the written blocks."""
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    table = blocks.filter("part = -1").select("payload").first()
    if table is None:
        raise ValueError("the table of frequencies is missing")
    freq = bytes(table[0])
    blocks = blocks.filter("part >= 0")
    names = ["doc_id", "part", "at", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Table.from_bytes(freq)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                ids = decode(row["payload"].as_py(), shared).astype("<u4")
                n = np.frombuffer(row["lengths"].as_py(), "<u4").astype(np.int64)
                ends = np.cumsum(n)
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                docs = row["docs"].values
                yield pa.RecordBatch.from_arrays([docs, pa.array(np.full(len(n), row["part"].as_py())), pa.array(row["before"].as_py() + ends - n), pa.array(n), pa.array(crc, pa.int64())], names)

    found = blocks.mapInArrow(run, f"doc_id {kind}, part long, at long, n_tokens long, ids_crc32 long")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each partition of the writer.
    ahead = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    return found.join(ahead, "part").select("doc_id", (F.col("at") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write and read back all of docs: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have one id, the end. Rows of a repeated id follow each other, in the order of a hash of their
    token ids; null ids come first; an empty table gives an empty result; other columns don't matter.
    """
    tokens, kind = tokenized(docs, path, end_id, id_col, text_col)
    tokens = materialize(tokens, "tokens")
    table = shared_table(tokens)
    blocks = write_blocks(tokens, table, kind)
    discard(tokens)
    return read_blocks(blocks)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
