"""SentencePiece encoding and decoding as a relational lattice.

Texts, with a space put in front, are cut into units that no piece crosses: before a word's spaces, around a line end, and
between any two characters whose neighbouring bytes no piece holds side by side. The substrings of a unit up to the longest piece are exploded and equi-joined to the piece table, and the edges found
are grouped by unit and folded to ids. For a unigram model the fold is Viterbi, the best sum of piece scores from the
left. For a BPE model the best sum of scores is not what the model encodes; its fold is the merge order (the best-scored
edge over two neighbouring symbols, the leftmost of equals, until none is left). Characters without an edge fall back to
bytes.

The units of all texts are counted, and the most frequent ones (`hot` at most, of MOST_BYTES bytes at most, so that they
take some 10 MB whatever the corpus) pass through that plan as DataFrame operations, with the fold as a higher-order
aggregate; their ids go to every executor. All others are encoded where their text is: explode, equi-join, group and fold
of the same lattice over the Arrow batch at hand, many units at once, with those met lately remembered. Texts are never
shuffled. Long units are cut where no edge crosses; what is still long merges by a heap, so a text without any space takes
near-linear time.

Within a slice of texts (about 1 MB) equal units are found by a 64-bit hash; decoding all ids checks every text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, id_text, load, materialize, most_frequent, text_buffers, trim
from tessera.llm.kernel import Hasher, slices

SPACE = "▁"
HOT = 30_000
MOST_BYTES = 64  # of a unit that all executors hold
FLUSH = 400_000  # units that a counting task holds before it passes them on
KNOWN = 300_000  # units that an encoding task remembers
AT_ONCE = 1 << 18  # bytes of units whose lattice is held at once
LONG = 64  # symbols that merge by a heap
CUT_EVERY, CUT_WITHIN = 1 << 16, 1 << 12  # longer units are cut at a crossing-free place of such a window, if there is one


@dataclass
class Vocabulary:
    """Pieces with their ids and scores; what a text needs before and after."""

    pieces: list[tuple[str, int, float]]
    byte_ids: list[int]
    unknown: int
    size: int
    bpe: bool
    texts: list[bytes]  # of each id, for decoding; byte pieces are their byte, control pieces nothing

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)

    @property
    def unknown_score(self) -> float:
        return min((s for _, _, s in self.pieces), default=0.0) - 10.0

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        scores = [m.get_score(i) for i in plain]
        # A BPE model scores its merges by rank: whole numbers, not log-probabilities.
        bpe = all(float(s).is_integer() for s in scores)
        texts = [b""] * n
        for i in range(n):
            if m.is_byte(i):
                texts[i] = bytes([int(m.id_to_piece(i)[3:5], 16)])
            elif m.is_unknown(i):
                texts[i] = " ⁇ ".encode()
            elif not m.is_control(i):
                texts[i] = m.id_to_piece(i).replace(SPACE, " ").encode()
        if m.normalize("x  ﬁ ") != f"{SPACE}x{SPACE}{SPACE}ﬁ{SPACE}":
            raise ValueError("only models that keep characters and spaces and put a space in front are supported")
        return cls([(m.id_to_piece(i), i, s) for i, s in zip(plain, scores, strict=True)], [i for i in range(n) if m.is_byte(i)], m.unk_id(), n, bpe, texts)


def joints(vocabulary: Vocabulary) -> np.ndarray:
    """Whether some piece holds two bytes side by side, [256, 256]; never across a line end, and a space only before what follows it."""
    out = np.zeros((256, 256), bool)
    for piece, _, _ in vocabulary.pieces:
        raw = np.frombuffer(piece.replace(SPACE, " ").encode(), np.uint8)
        out[raw[:-1], raw[1:]] = True
    out[:, 0x80:0xC0] = True  # within a character
    return out


def unit_bounds(data: np.ndarray, offsets: np.ndarray, joint: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with a space in front of each that isn't empty, their bounds, and (start, end, row) of their units."""
    if len(data) > 2 and ((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)).any():  # the character that stands for a space is one
        texts = [data[a:b].tobytes().replace(SPACE.encode(), b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    full = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][full], 0x20)
    offsets = offsets + np.r_[0, np.cumsum(full)]
    start = np.zeros(len(data) + 1, bool)
    start[offsets[:-1][full]] = True
    if len(data):
        start[1:-1] |= ~joint.ravel()[data[:-1].astype(np.int64) << 8 | data[1:]]
    s = np.flatnonzero(start[:-1])
    return data, offsets, s, np.r_[s[1:], len(data)] if len(s) else s, np.searchsorted(offsets, s, "right") - 1


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    return spark.createDataFrame(vocabulary.pieces, "piece string, id int, score double")


def substrings(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The substrings (unit, at, size, piece) of every unit up to the longest piece."""
    rows = units.select("unit", F.translate("unit", " ", SPACE).alias("norm")).withColumn("n", F.length("norm"))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(vocabulary.longest), F.col("n") - F.col("at")))))
    return rows.select("unit", "at", "size", F.substr("norm", F.col("at") + 1, F.col("size")).alias("piece"))


def edges(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(unit, edges): the lattice of each unit, an array of (at, size, id, score) with positions from 0."""
    # The piece table is bounded by the vocabulary, whatever the corpus.
    lattice = substrings(units, vocabulary).join(F.broadcast(piece_table(units.sparkSession, vocabulary)), "piece")
    return lattice.groupBy("unit").agg(F.collect_list(F.struct("at", "size", "id", "score")).alias("edges"))


def _key(at: Column, size: Column) -> Column:
    return at * 64 + size


def merge_fold(norm: Column, found: Column) -> Column:
    """Symbol bounds after all merges in order of score."""
    table = F.map_from_entries(F.transform(found, lambda e: F.struct(_key(e["at"], e["size"]), e["score"])))
    n = F.length(norm)
    start = F.struct(F.sequence(F.lit(0), n).alias("b"), F.lit(False).alias("done"), table.alias("t"))

    def step(acc: Column, _: Column) -> Column:
        b = acc["b"]
        pairs = F.transform(F.sequence(F.lit(0), F.size(b) - 3), lambda i: F.struct(F.try_element_at(acc["t"], _key(F.get(b, i), F.get(b, i + 2) - F.get(b, i))).alias("s"), (-i).alias("i")))
        best = F.array_max(F.filter(pairs, lambda p: p["s"].isNotNull()))
        gone = 1 - best["i"]
        merged = F.struct(F.filter(b, lambda _, i: i != gone).alias("b"), F.lit(False).alias("done"), acc["t"].alias("t"))
        stop = F.struct(b.alias("b"), F.lit(True).alias("done"), acc["t"].alias("t"))
        return F.when(acc["done"] | (F.size(b) < 3), stop).otherwise(F.when(best.isNull(), stop).otherwise(merged))

    return F.aggregate(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: acc["b"])


def viterbi_fold(norm: Column, found: Column, unknown: float) -> Column:
    """Symbol bounds of the best sum of scores; a character without an edge costs `unknown`. Of equals, the longest last piece."""
    n = F.length(norm)
    state = F.struct(F.array(F.struct(F.lit(0.0).alias("s"), F.array(F.lit(0)).alias("b"))).alias("best"))

    def step(acc: Column, end: Column) -> Column:
        best = acc["best"]
        coming = F.filter(found, lambda e: e["at"] + e["size"] == end)
        ways = F.transform(coming, lambda e: F.struct((F.get(best, e["at"])["s"] + e["score"]).alias("s"), (-e["at"]).alias("k")))
        single = F.exists(coming, lambda e: e["size"] == 1)
        ways = F.concat(ways, F.when(single, F.array().cast("array<struct<s:double,k:int>>")).otherwise(F.array(F.struct((F.get(best, end - 1)["s"] + F.lit(unknown)).alias("s"), (1 - end).alias("k")))))
        chosen = F.array_max(ways)
        bounds = F.concat(F.get(best, -chosen["k"])["b"], F.array(end))
        return F.struct(F.concat(best, F.array(F.struct(chosen["s"].alias("s"), bounds.alias("b")))).alias("best"))

    return F.aggregate(F.sequence(F.lit(1), n), state, step, lambda acc: F.get(acc["best"], n)["b"])


def encoded_units(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(unit, ids): ids of every distinct unit of column unit, by the plan of DataFrame operations."""
    lattice = units.select("unit").distinct()
    lattice = lattice.join(edges(lattice, vocabulary), "unit", "left")
    found = F.coalesce("edges", F.array().cast("array<struct<at:int,size:int,id:int,score:double>>"))
    rows = lattice.select("unit", F.translate("unit", " ", SPACE).alias("norm"), found.alias("edges"))
    bounds = merge_fold(F.col("norm"), F.col("edges")) if vocabulary.bpe else viterbi_fold(F.col("norm"), F.col("edges"), vocabulary.unknown_score)
    table = F.map_from_entries(F.transform("edges", lambda e: F.struct(_key(e["at"], e["size"]), e["id"])))
    rows = rows.select("unit", "norm", "edges", bounds.alias("b")).select("unit", "norm", "b", table.alias("t"))
    first_byte = vocabulary.byte_ids[0] if vocabulary.byte_ids else None

    def bytes_of(c: Column) -> Column:
        if first_byte is None:
            return F.array(F.lit(vocabulary.unknown))
        text = F.hex(F.encode(c, "UTF-8"))
        return F.transform(F.sequence(F.lit(0), (F.length(text) / 2).cast("int") - 1), lambda i: F.conv(F.substr(text, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + first_byte)

    def ids_of(i: Column) -> Column:
        at, size = F.get("b", i), F.get("b", i + 1) - F.get("b", i)
        known = F.try_element_at("t", _key(at, size))
        return F.when(known.isNotNull(), F.array(known)).otherwise(bytes_of(F.substr("norm", at + 1, size)))

    return rows.select("unit", F.flatten(F.transform(F.sequence(F.lit(0), F.size("b") - 2), ids_of)).alias("ids"))


class Lattice:
    """The same for many units at once, given as bytes: explode, equi-join by 64-bit hash and length, group, fold."""

    def __init__(self, vocabulary: Vocabulary):
        pieces = [p.replace(SPACE, " ").encode() for p, _, _ in vocabulary.pieces]
        size = np.array([len(p) for p in pieces], np.int64)
        end = np.cumsum(size)
        hashes = Hasher(np.frombuffer(b"".join(pieces), np.uint8))(end - size, end)
        order = np.argsort(hashes)
        self.hashes, self.sizes = hashes[order], size[order]
        self.ids = np.array([i for _, i, _ in vocabulary.pieces], np.int32)[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(hashes)] = True
        self.scores = np.full(vocabulary.size, -np.inf)
        self.scores[self.ids] = np.array([s for _, _, s in vocabulary.pieces])[order]
        self.rank = np.unique(self.scores, return_inverse=True)[1].astype(np.int64)
        self.longest, self.bpe, self.unknown_score = vocabulary.longest, vocabulary.bpe, vocabulary.unknown_score
        self.byte_ids = np.array(vocabulary.byte_ids, np.int32) if vocabulary.byte_ids else None
        self.unknown = vocabulary.unknown

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << 20) - 1)).astype(np.int64)

    def edges(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte offsets of characters, characters ahead of each unit, and the piece [character, size] or -1."""
        char = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(char, bounds)
        stop = np.repeat(first[1:], np.diff(first))
        at, hasher = np.arange(len(char)), Hasher(data)
        char = np.r_[char, len(data)]
        piece = np.full((len(at), self.longest + 1), -1, np.int32)
        for size in range(1, self.longest + 1):
            at = at[at + size <= stop[at]]
            if not len(at):
                break
            s, e = char[at], char[at + size]
            hashes = hasher(s, e)
            hit = np.flatnonzero(self.maybe[self._slot(hashes)])
            k = np.minimum(np.searchsorted(self.hashes, hashes[hit]), len(self.hashes) - 1)
            same = (self.hashes[k] == hashes[hit]) & (self.sizes[k] == (e - s)[hit])
            piece[at[hit[same]], size] = self.ids[k[same]]
        return char, first, piece

    def _free(self, piece: np.ndarray) -> np.ndarray:
        """Whether no edge crosses the place before a character."""
        at, size = np.nonzero(piece[:, 2:] >= 0)
        n = len(piece) + 1
        return np.cumsum(np.bincount(at + 1, minlength=n) - np.bincount(at + size + 2, minlength=n))[:-1] == 0

    def _merged(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols [s, e) of all units after all merges."""
        free = self._free(piece)
        begin = np.flatnonzero(free)
        size = np.diff(np.r_[begin, len(piece)])
        out = [(begin[size == 1], begin[size == 1] + 1)]
        for b, n in zip(begin[size > LONG].tolist(), size[size > LONG].tolist(), strict=True):
            out.append(self._long(piece[b : b + n], b))
        u = np.flatnonzero((size > 1) & (size <= LONG))
        s = np.arange(int(size[u].sum())) - np.repeat(np.cumsum(size[u]) - size[u], size[u]) + np.repeat(begin[u], size[u])
        e, u = s + 1, np.repeat(u, size[u])
        while len(u):
            first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
            value = np.full(len(u), -1, np.int64)
            span = np.r_[e[1:] - s[:-1], 0]
            pair = np.flatnonzero(np.r_[u[1:] == u[:-1], False] & (span <= self.longest))
            found = piece[s[pair], span[pair]]
            pair, found = pair[found >= 0], found[found >= 0]
            value[pair] = self.rank[found] * (1 << 32) + (1 << 31) - s[pair]
            best = np.maximum.reduceat(value, first)
            open_ = np.repeat(best >= 0, np.diff(np.r_[first, len(u)]))
            if not open_.all():
                out.append((s[~open_], e[~open_]))
            take = np.flatnonzero(open_ & (value == np.repeat(best, np.diff(np.r_[first, len(u)]))))
            e[take] = e[take + 1]
            open_[take + 1] = False
            u, s, e = u[open_], s[open_], e[open_]
        s, e = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(s)
        return s[order], e[order]

    def _long(self, piece: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray]:
        """The merge order of one run by a heap of the pairs that may merge."""
        n, longest, rank = len(piece), self.longest, self.rank
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = piece[: n - 1, 2]
        hit = np.flatnonzero(first >= 0)
        heap = list(zip((-rank[first[hit]]).tolist(), hit.tolist(), (hit + 1).tolist(), (hit + 2).tolist(), strict=True))
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, a, mid, c = heapq.heappop(heap)
            if not alive[a] or end[a] != mid or not alive[mid] or end[mid] != c:
                continue
            end[a], alive[mid] = c, 0
            if c < n:
                before[c] = a
                stop = end[c]
                if stop - a <= longest and (p := piece[a, stop - a]) >= 0:
                    heapq.heappush(heap, (-int(rank[p]), a, c, stop))
            if (b := before[a]) >= 0 and c - b <= longest and (p := piece[b, c - b]) >= 0:
                heapq.heappush(heap, (-int(rank[p]), b, a, c))
        s = np.flatnonzero(np.frombuffer(bytes(alive), np.uint8))
        return s + ahead, np.r_[s[1:], n] + ahead

    def _best(self, piece: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols [s, e) of the best sum of scores of each unit."""
        out_s, out_e = [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            best, back = [0.0] + [-np.inf] * (b - a), [0] * (b - a + 1)
            for end in range(1, b - a + 1):
                for size in range(1, min(end, self.longest) + 1):
                    p = piece[a + end - size, size]
                    if p < 0 and size > 1:
                        continue
                    total = best[end - size] + (self.scores[p] if p >= 0 else self.unknown_score)
                    if total >= best[end]:
                        best[end], back[end] = total, end - size
            cuts = [b - a]
            while cuts[-1]:
                cuts.append(back[cuts[-1]])
            cuts = [a + c for c in reversed(cuts)]
            out_s += cuts[:-1]
            out_e += cuts[1:]
        return np.array(out_s, np.int64), np.array(out_e, np.int64)

    def _parts(self, unit: bytes) -> list[bytes]:
        """A unit cut where no edge crosses, about every CUT_EVERY bytes."""
        if not self.bpe or len(unit) <= 2 * CUT_EVERY:
            return [unit]
        data, cuts = np.frombuffer(unit, np.uint8), [0]
        for k in range(CUT_EVERY, len(unit) - CUT_WITHIN, CUT_EVERY):
            near = k + np.flatnonzero((data[k : k + CUT_WITHIN] & 0xC0) != 0x80)
            if len(near) > 4 * self.longest:
                part = data[near[0] : near[-1]]
                char, _, piece = self.edges(part, np.array([0, len(part)]))
                free = np.flatnonzero(self._free(piece)[self.longest : -self.longest])
                if len(free):
                    cuts.append(int(near[0] + char[self.longest + free[0]]))
        return [unit[a:b] for a, b in zip(cuts, [*cuts[1:], len(unit)], strict=True)]

    def encode(self, units: list[bytes], kind: np.dtype) -> list[bytes]:
        """The ids of each unit as bytes of an integer type."""
        out: list[bytes] = []
        wide = [u for u in units if len(u) > 2 * CUT_EVERY]
        known = {u: b"".join(self._encode([p], kind)[0] for p in self._parts(u)) for u in wide}
        units_, size, held = [], 0, []
        for u in units:
            if u in known:
                continue
            held.append(u)
            size += len(u)
            if size > AT_ONCE:
                units_.append(held)
                size, held = 0, []
        for group in [*units_, held]:
            if group:
                out += self._encode(group, kind)
        if not known:
            return out
        rest = iter(out)
        return [known[u] if u in known else next(rest) for u in units]

    def _encode(self, units: list[bytes], kind: np.dtype) -> list[bytes]:
        data = np.frombuffer(b"".join(units), np.uint8)
        char, first, piece = self.edges(data, np.cumsum([0, *map(len, units)]))
        s, e = self._merged(piece) if self.bpe else self._best(piece, first)
        ids = piece[s, np.minimum(e - s, self.longest)]
        plain = ids >= 0
        size = np.ones(len(ids), np.int64)
        if self.byte_ids is not None:
            size[~plain] = (char[e] - char[s])[~plain]
        ends = np.cumsum(size)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, kind)
        flat[ends[plain] - 1] = ids[plain]
        if not plain.all():
            if self.byte_ids is None:
                flat[ends[~plain] - 1] = self.unknown
            else:
                n = size[~plain]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                flat[np.repeat(ends[~plain] - n, n) + step] = self.byte_ids[data[np.repeat(char[s[~plain]], n) + step]]
        per = np.r_[0, ends][np.searchsorted(s, first)] * flat.itemsize
        return list(map(flat.tobytes().__getitem__, map(slice, per[:-1].tolist(), per[1:].tolist())))


def distinct_units(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different units of some texts, and the index of each unit among them."""
    _, first, inverse = np.unique(Hasher(data)(s, e), return_index=True, return_inverse=True)
    return list(map(data.tobytes().__getitem__, map(slice, s[first].tolist(), e[first].tolist()))), inverse


def unit_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(unit, n) of all texts."""
    joint = joints(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["unit", "n"])
            held.clear()
            return out

        for batch in batches:
            for _, _, data, at in slices(*text_buffers(batch.column(0))):
                data, _, s, e, _ = unit_bounds(data, at, joint)
                units, index = distinct_units(data, s, e)
                for u, n in zip(units, np.bincount(index, minlength=len(units)).tolist(), strict=True):
                    held[u] = held.get(u, 0) + n
                if len(held) > FLUSH:
                    yield flush()
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent_units(docs: DataFrame, vocabulary: Vocabulary, hot: int) -> list[tuple[bytes, list[int]]]:
    """The most frequent units of all texts, with their ids."""
    counted = materialize(unit_counts(docs, vocabulary), "units")
    often = most_frequent(counted.filter(F.octet_length("unit") <= MOST_BYTES), "n", hot).select("unit")
    spread = often.repartition(max(8, often.sparkSession.sparkContext.defaultParallelism), "unit")
    got = encoded_units(spread, vocabulary).toArrow()
    discard(counted)
    return [(u.encode(), ids) for u, ids in zip(got.column("unit").to_pylist(), got.column("ids").to_pylist(), strict=True)]


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, known: int = KNOWN) -> DataFrame:
    """(doc_id, ids, restored) for every row of docs.

    A null or empty text has no ids; repeated rows and null ids of any type are kept; an empty table gives an empty
    result; other columns don't matter.
    """
    rows = id_text(docs, id_col, text_col)
    width = np.dtype("<u2" if vocabulary.size <= 1 << 16 else "<i4")
    often = {u: np.array(ids, width).tobytes() for u, ids in frequent_units(rows, vocabulary, hot)}
    shared = docs.sparkSession.sparkContext.broadcast((often, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, vocabulary = shared.value
        lattice, met, joint = Lattice(vocabulary), dict(often), joints(vocabulary)
        piece_size = np.array([len(t) for t in vocabulary.texts], np.int64)
        piece_at, piece_bytes = np.cumsum(piece_size) - piece_size, np.frombuffer(b"".join(vocabulary.texts), np.uint8)
        for batch in batches:
            for lo, hi, data, at in slices(*text_buffers(batch.column(1))):
                data, at, s, e, row = unit_bounds(data, at, joint)
                units, index = distinct_units(data, s, e)
                found = list(map(met.get, units))
                if None in found:
                    if len(met) > known + len(often):
                        met = dict(often)
                    fresh = [u for u, x in zip(units, found, strict=True) if x is None]
                    learnt = dict(zip(fresh, lattice.encode(fresh, width), strict=True))
                    met.update((u, x) for u, x in learnt.items() if len(u) <= 4 * MOST_BYTES)
                    found = [learnt[u] if x is None else x for u, x in zip(units, found, strict=True)]
                size = np.array(list(map(len, found)), np.int64) // width.itemsize
                pool = np.frombuffer(b"".join(found), width)
                own = size[index]
                total = int(own.sum())
                ids = pool[np.arange(total) + np.repeat((np.cumsum(size) - size)[index] - (np.cumsum(own) - own), own)]
                ends = np.r_[0, np.cumsum(np.bincount(row, own, len(at) - 1))].astype(np.int32)
                long_ = piece_size[ids]
                back = piece_bytes[np.arange(int(long_.sum())) + np.repeat(piece_at[ids] - (np.cumsum(long_) - long_), long_)]
                if len(back) == len(data):
                    same = np.ones(hi - lo, bool)
                    same[np.searchsorted(at, np.flatnonzero(back != data), "right") - 1] = False
                else:
                    cut = np.r_[0, np.cumsum(long_)][ends]
                    same = np.array([np.array_equal(back[cut[k] : cut[k + 1]], data[at[k] : at[k + 1]]) for k in range(hi - lo)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))), pa.array(same)], ["doc_id", "ids", "restored"])
        del lattice, met
        trim()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, restored boolean")


def text_of(ids: np.ndarray, pieces: list[bytes]) -> str:
    """The text of some ids, without the space put in front."""
    text = b"".join(map(pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """encoded with its columns and `decoded`, the text of the ids; null ids decode to null."""
    texts = vocabulary.texts

    @F.pandas_udf("string")
    def run(values):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([None if ids is None else text_of(np.asarray(ids), texts) for ids in values], dtype=object)

    return encoded.withColumn("decoded", run(F.col(ids_col)))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """doc_id, n_tokens, ids, restored: whether the ids decode to the text (a character that means a space comes back as one)."""
    out = encode(docs, vocabulary, id_col, text_col, **sizes)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "restored")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(load(spark, sf_dir, "documents"), Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model")))
