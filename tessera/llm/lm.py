"""Language-model scores: a hierarchical Pitman-Yor model of words in context, of words and of their spelling.

Every word, and the end of a text, is a dish in the restaurant of the word before it (of START for the first). These
context restaurants share one parent, the restaurant of words without context, whose customers are the tables of all
context restaurants. Its own base measure spells a word byte by byte: context restaurants of three bytes share parents of
two bytes, these of one byte, and those one parent without context, over a uniform choice of 256 bytes and a word end;
every table of the word restaurant sends one spelled word down. Unseen pairs and words keep a proper probability at every level, so
held-out text can be scored, and a text that the corpus holds twice is told from one that it holds once.

Seating is sampled by Gibbs sweeps. In a sweep the customers of a dish leave their restaurant and are seated anew, one
at a time, by the Chinese-restaurant rule given all other dishes and the parent's present predictive; beyond twenty
customers of a dish they arrive in groups of a twentieth of those present, seated by a binomial draw. Dishes are
reseated in parallel against the table totals of the sweep before. After the burn-in, predictive probabilities are
averaged over the kept sweeps.

How it runs. All counts are exact and none leaves the executors, but for the spelling after two bytes (at most 258 ** 2
contexts of 257 symbols) and totals of a few contexts that hold a large share of all pairs.

* Texts are packed in chunks of about CHUNK bytes: token numbers, and the chunk's different words with their counts.
* Words go to buckets by a hash, which merge them over all chunks and answer each chunk with their numbers and counts.
* Pairs of word numbers go to buckets by their first word, so that a bucket holds whole restaurants; the pairs of a
  frequent first word are spread over all buckets, and its totals are summed apart. Lists are sorted, so a pair costs
  about three bytes on its way.
* Events of three bytes go to buckets by their context. In a sweep, word buckets send the tables of their words there, and
  get what each event has of its own and the weight of its parent back; only the parents' tables go to the driver.
* In a sweep, pair buckets send the tables of each word up to the word buckets, and get its predictive back.
* At the end each chunk asks for its pairs in the same order again, so that only probabilities return to it.

Words are told apart by 64-bit hashes. Draws are seeded by sweep and bucket, and buckets depend on the texts alone, so
results don't depend on the partitioning.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, held_out_expr, id_text, load, materialize, release, text_buffers
from tessera.llm.kernel import Hasher, mix, slices, word_bounds

BURN_IN, KEPT = 1, 2  # sweeps
THETA = 1.0
CHUNK = 8 << 20  # bytes of text in a chunk
WORD_BYTES, PAIR_BYTES = 32 << 20, 8 << 20  # bytes of text for each bucket of words and of pairs
FREQUENT = 4  # a first word is frequent if it begins more than one FREQUENT-th of a bucket's pairs
END = b"\n"  # the end of a text; no word holds it
STOP, START, SYMBOLS = 256, 257, 258
END_HASH = np.uint64(0x1D8E4E27C47D124F)
LN10 = float(np.log(10.0))


# Arrays on their way: sorted numbers as differences, all as planes of bytes, compressed.


def put(*arrays: np.ndarray) -> bytes:
    squeeze = zstandard.ZstdCompressor(1)
    parts = []
    for x in arrays:
        x = np.ascontiguousarray(x)
        raw = squeeze.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()) if len(x) else b""
        code = x.dtype.str.encode()
        parts += [struct.pack("<4sQQ", code, len(x), len(raw)), raw]
    return b"".join(parts)


def get(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        code, n, size = struct.unpack_from("<4sQQ", raw, at)
        dtype, at = np.dtype(code.rstrip(b"\0").decode()), at + 20
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[at : at + size]) if n else b"", np.uint8)
        out.append(np.ascontiguousarray(flat.reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype))
        at += size
    return out


def steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def narrow(x: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds x."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def wide(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64)


def _logs(lp: np.ndarray) -> list[np.ndarray]:
    """-log10 of probabilities in steps of 1 / 2040; those over 32 apart, as they are."""
    code = np.minimum(np.round(-lp * 2040), 65535)
    far = code >= 65280
    return [np.where(far, 65535, np.maximum(code, 0)).astype(np.uint16), lp[far].astype(np.float32)]


def _unlogs(code: np.ndarray, far: np.ndarray) -> np.ndarray:
    out = code / -2040.0
    out[code == 65535] = far
    return out


def log10_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log10 of 10 ** a + 10 ** b."""
    return np.logaddexp(a * LN10, b * LN10) / LN10


def log10(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log10(x)


def seat(count: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with `count` customers each (at least one), parent probability `base`, and tables of other dishes.

    A further customer opens a table with weight (theta + discount * tables) * base against customers - discount * own
    tables.
    """
    tables = np.ones(len(count), np.int64)
    more = np.flatnonzero(count > 1)
    order = more[np.argsort(-count[more], kind="stable")]
    c, p, o = count[order].astype(np.int64), base[order], others[order].astype(np.float64)
    own = np.ones(len(c), np.int64)
    here, live = 1, len(c)
    while live:
        step = 1 if here < 20 else here // 20
        add = np.minimum(step, c[:live] - here)
        t = own[:live]
        opens = (theta + discount * (o[:live] + t)) * p[:live]
        own[:live] += rng.binomial(add, opens / (here - discount * t + opens))
        here += step
        live = int(np.searchsorted(-c[:live], -here, "left"))
    tables[order] = own
    return tables


def discount_of(once: int, twice: int) -> float:
    return min(0.98, max(0.1, once / (once + 2 * twice) if once else 0.5))


class Level:
    """Context restaurants over a parent: a fixed predictive of sampled seats. keys: (context, symbol) in base SYMBOLS, ascending."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, parent: np.ndarray, rng: np.random.Generator, discount: float | None = None):
        self.keys = keys
        self.contexts, at = np.unique(keys // SYMBOLS, return_inverse=True)
        d = _discount(counts) if discount is None else discount
        tables = seat(counts, parent, np.zeros(len(keys)), d, THETA, rng)
        self.tables = seat(counts, parent, np.bincount(at, tables)[at] - tables if len(keys) else tables, d, THETA, rng)
        n, own = np.bincount(at, counts), np.bincount(at, self.tables)
        self.direct = (counts - d * self.tables) / (THETA + n)[at] if len(keys) else np.zeros(0)
        self.back = (THETA + d * own) / (THETA + n)

    def shares(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What events have of their own, and the weight of the parent's predictive."""
        if not len(self.keys):
            return np.zeros(len(key)), np.ones(len(key))
        context = key // SYMBOLS
        g = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.direct[k], 0.0), np.where(self.contexts[g] == context, self.back[g], 1.0)

    def over(self, key: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """The predictive of events, given the parent's."""
        direct, back = self.shares(key)
        return direct + parent * back


class Spelling:
    """The context restaurants of the spelling, from three bytes of context to none."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def sample(cls, keys: np.ndarray, counts: np.ndarray, more: np.ndarray, more_counts: np.ndarray, before: Spelling | None, rng: np.random.Generator) -> Spelling:
        """One Gibbs sweep from the leaves up. keys: (three bytes, symbol), ascending; more: (two bytes, symbol) of events without a dish there."""
        levels = []
        for depth in (3, 2, 1, 0):
            parent = before.predictive(keys % SYMBOLS**depth, depth - 1) if before else np.full(len(keys), 1 / 257)
            levels.append(Level(keys, counts, parent, rng))
            below, tables = keys % SYMBOLS**depth, levels[-1].tables
            if depth == 3:
                below, tables = np.r_[below, more], np.r_[tables, more_counts]
            keys, at = np.unique(below, return_inverse=True)
            counts = np.bincount(at, tables, len(keys)).astype(np.int64)
        return cls(levels)

    def predictive(self, key: np.ndarray, depth: int) -> np.ndarray:
        """Probability of the symbol of each key after `depth` bytes of context."""
        p = np.full(len(key), 1 / 257)
        for d in range(depth + 1):
            p = self.levels[3 - d].over(key % SYMBOLS ** (d + 1), p)
        return p

    def log10(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """log10 probability of each spelled word with its end; END spells as the empty word, which no other does."""
        key, begins, _ = _spelled(data, size)
        return np.add.reduceat(np.log10(self.predictive(key, 3)), begins) if len(begins) else np.zeros(0)


class SpreadSpelling(Spelling):
    """A spelling whose three-byte restaurants stay in a table, where what is asked of them is looked up."""

    def __init__(self, levels: list[Level], events: DataFrame, buckets: int):
        super().__init__(levels)
        self.events, self.buckets = events, buckets

    def predictive(self, key: np.ndarray, depth: int) -> np.ndarray:
        p = super().predictive(key, min(depth, 2))
        if depth < 3:
            return p
        bucket = _event_bucket(key, self.buckets)
        rows = self.events.filter("chunk < 0").filter(F.col("bucket").isin(np.unique(bucket).tolist())).select("bucket", "payload")
        for r in rows.toLocalIterator():
            step, direct, back, *_ = get(r.payload)
            contexts, first = np.unique((keys := np.cumsum(step)) // SYMBOLS, return_index=True)
            mine = np.flatnonzero(bucket == r.bucket)
            k = np.minimum(np.searchsorted(keys, key[mine]), len(keys) - 1)
            g = np.minimum(np.searchsorted(contexts, key[mine] // SYMBOLS), len(contexts) - 1)
            weight = np.where(contexts[g] == key[mine] // SYMBOLS, back[first[g]], 1.0)
            p[mine] = np.where(keys[k] == key[mine], direct[k], 0.0) + weight * p[mine]
        return p


def _discount(counts: np.ndarray) -> float:
    return discount_of(int((counts == 1).sum()), int((counts == 2).sum()))


def _spelled(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(three bytes before, symbol) of all symbols of the words (bytes one after the other, their sizes), and the first and number of each word's."""
    mark = np.flatnonzero(data == 10)  # END alone is a line end
    if len(mark):
        at = np.searchsorted(np.cumsum(size), mark, "right")
        data, size = np.delete(data, mark), size.copy()
        size[at] = 0
    full = size + 1
    ends = np.cumsum(full)
    symbols = np.full(int(ends[-1]) if len(ends) else 0, STOP, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    symbols[inside] = data
    begins = ends - full
    key, back = symbols.copy(), symbols
    for k in (1, 2, 3):
        back = np.r_[START, back[:-1]] if len(back) else back
        back[begins] = START
        key += back * SYMBOLS**k
    return key, begins, full


def spelled_keys(data: np.ndarray, size: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, summed weight) of the (three bytes before, symbol) events of some words."""
    key, _, full = _spelled(data, size)
    keys, at = np.unique(key, return_inverse=True)
    return keys, np.bincount(at, np.repeat(weights, full), len(keys)).astype(np.int64)


# Chunks and words.

ROWS = "bucket long, chunk long, payload binary"


def packed(rows: DataFrame, buckets: int, size: int = CHUNK) -> DataFrame:
    """Chunks of rows (who, held_out, text): (bucket -1, chunk, payload, who), and for each bucket the chunk's words.

    A chunk's words are numbered by bucket, then hash, as its buckets' answers will come.
    """
    kind = rows.schema["who"].dataType.simpleString()
    names = ["bucket", "chunk", "payload", "who"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.taskcontext import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        who: list[pa.Array] = []
        bytes_ = 0
        who_type = pa.null()

        def flush() -> pa.RecordBatch:
            tok, lens, test = (np.concatenate(x) for x in list(zip(*held, strict=True))[:3])
            text = np.concatenate([x[3] for x in held])
            base = np.cumsum([0, *(len(x[3]) for x in held)])
            s, e = (np.concatenate([np.where(x[k] >= 0, x[k] + b, -1) for x, b in zip(held, base[:-1], strict=True)]) for k in (4, 5))
            found, first, inverse = np.unique(tok, return_index=True, return_inverse=True)
            bucket = (mix(found) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            count = np.bincount(inverse[~np.repeat(test, lens)], minlength=len(found))[order]
            found, first, bucket = found[order], first[order], bucket[order]
            s, e = s[first], e[first]
            n = np.where(s >= 0, e - s, 1)
            letters = np.full(int(n.sum()), 10, np.uint8)
            begin = np.cumsum(n) - n
            word = s >= 0
            inside = np.arange(int(n[word].sum())) - np.repeat(np.cumsum(n[word]) - n[word], n[word])
            letters[inside + np.repeat(begin[word], n[word])] = text[inside + np.repeat(s[word], n[word])]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            out = [(-1, put(narrow(place[inverse]), narrow(lens), test), pa.concat_arrays(who))]
            for b in range(buckets):
                i, j = cut[b], cut[b + 1]
                if i < j:
                    out.append((b, put(steps(found[i:j]), narrow(count[i:j]), narrow(n[i:j]), letters[begin[i] : begin[j - 1] + n[j - 1]]), None))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.full(len(out), len(out[0][2]))].astype(np.int32)), out[0][2])
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array(np.full(len(out), chunk)), pa.array([x[1] for x in out], pa.binary()), lists.cast(pa.list_(who_type))], names)

        for batch in batches:
            who_type = batch.schema.field("who").type
            for lo, hi, data, at in slices(*text_buffers(batch.column("text"))):
                data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
                s, e, row = word_bounds(data, at)
                n = np.bincount(row, minlength=hi - lo)
                ends = np.cumsum(n + 1)
                tok = np.empty(len(s) + hi - lo, np.uint64)
                begin, end = np.full(len(tok), -1), np.full(len(tok), -1)
                tok[ends - 1] = END_HASH
                to = np.arange(len(s)) + row
                tok[to], begin[to], end[to] = Hasher(data)(s, e), s, e
                test = batch.column("held_out").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                held.append((tok, n + 1, test, data, begin, end))
                who.append(batch.column("who").slice(lo, hi - lo))
                bytes_ += len(data)
                if bytes_ >= size:
                    yield flush()
                    held, who, bytes_, chunk = [], [], 0, chunk + 1
        if held:
            yield flush()

    return rows.select("who", "held_out", "text").mapInArrow(run, f"{ROWS}, who array<{kind}>")


def _merged(lists: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different values of some lists, the first place and the sum of counts of each, and the value of each place."""
    found, first, inverse = np.unique(np.concatenate(lists), return_index=True, return_inverse=True)
    return found, first, np.bincount(inverse, np.concatenate(counts), len(found)).astype(np.int64), inverse


def merged_words(requests: DataFrame) -> DataFrame:
    """For each bucket its words (chunk -1: counts, sizes, letters) with totals, and the answer to each chunk: numbers within the bucket, and counts."""
    names = ["bucket", "chunk", "payload", "size", "tokens", "words", "once", "twice"]

    def run(table: pa.Table) -> pa.Table:
        parts = [get(x) for x in table.column("payload").to_pylist()]
        hashes = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
        _, first, count, inverse = _merged(hashes, [wide(p[1]) for p in parts])
        size = np.concatenate([wide(p[2]) for p in parts])
        letters = np.concatenate([p[3] for p in parts])
        begin = (np.cumsum(size) - size)[first]
        own = size[first]
        at = np.arange(int(own.sum())) + np.repeat(begin - (np.cumsum(own) - own), own)
        b = table.column("bucket")[0].as_py()
        out = [(b, -1, put(narrow(count), narrow(own), letters[at]), len(count), int(count.sum()), int((count > 0).sum()), int((count == 1).sum()), int((count == 2).sum()))]
        done = 0
        for chunk, h in zip(table.column("chunk").to_pylist(), hashes, strict=True):
            mine = inverse[done : done + len(h)]
            done += len(h)
            out.append((b, chunk, put(narrow(steps(mine)), narrow(count[mine])), 0, 0, 0, 0, 0))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5], strict=True)], names)

    return requests.select("bucket", "chunk", "payload").groupBy("bucket").applyInArrow(run, f"{ROWS}, size long, tokens long, words long, once long, twice long")


class Plan:
    """Totals that all tasks know: bounded by the number of buckets, not by the corpus."""

    def __init__(self, offsets: np.ndarray, tokens: int, words: int, pair_buckets: int, frequent: dict[int, int]):
        self.offsets, self.tokens, self.words, self.pair_buckets = offsets, tokens, words, pair_buckets
        self.start = int(offsets[-1])  # number of START; word numbers are below
        self.often = np.array(sorted(frequent), np.int64)
        self.often_count = np.array([frequent[k] for k in sorted(frequent)], np.int64)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.words + 1))

    def split(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return code // (self.start + 1), code % (self.start + 1)

    def is_often(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.often):
            return np.zeros(len(u), bool), np.zeros(len(u), np.int64)
        at = np.minimum(np.searchsorted(self.often, u), len(self.often) - 1)
        return self.often[at] == u, at

    def pairs(self, tokens: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different pairs of some texts by bucket and number, the bounds of the buckets, and the pair of each token."""
        before = np.r_[self.start, tokens[:-1]] if len(tokens) else tokens
        before[np.cumsum(lens) - lens] = self.start
        found, inverse = np.unique(before * (self.start + 1) + tokens, return_inverse=True)
        u = found // (self.start + 1)
        often, _ = self.is_often(u)
        bucket = (mix(np.where(often, found, u).astype(np.uint64)) % np.uint64(self.pair_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return found[order], np.searchsorted(bucket[order], np.arange(self.pair_buckets + 1)), place[inverse]

    def totals(self, u: np.ndarray, value: np.ndarray, often: np.ndarray) -> np.ndarray:
        """For ascending u the sum of value over equal ones; often: that of the frequent words, wherever their pairs are."""
        first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, np.int64)
        out = np.repeat(np.add.reduceat(value, first) if len(first) else value, np.diff(np.r_[first, len(u)]))
        hit, at = self.is_often(u)
        return np.where(hit, often[at], out) if len(often) else out


def numbered(chunks: DataFrame, answers: DataFrame, plan: Plan, who: str) -> DataFrame:
    """Chunks with their words' numbers and the figures of each text (bucket -1), and for each bucket the chunk's pairs."""
    names = ["bucket", "chunk", "payload", "who"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place, lens, test = get(left.column("payload")[0].as_py())
        place, lens, test = wide(place), wide(lens), test.astype(bool)
        order = np.argsort(right.column("bucket").to_numpy())
        parts = [get(right.column("payload")[k].as_py()) for k in order.tolist()]
        buckets = right.column("bucket").to_numpy()[order].tolist()
        ids = np.concatenate([np.cumsum(wide(p[0])) + plan.offsets[b] for p, b in zip(parts, buckets, strict=True)])
        count = np.concatenate([wide(p[1]) for p in parts])
        tokens = ids[place]
        first = np.cumsum(lens) - lens
        known = np.add.reduceat((count > 0)[place].astype(np.int64), first)
        base = np.add.reduceat(plan.base(count)[place], first)
        found, cut, inverse = plan.pairs(tokens, lens)
        seen = np.bincount(inverse[~np.repeat(test, lens)], minlength=len(found))
        chunk = left.column("chunk")[0].as_py()
        out = [(-1, put(narrow(place), narrow(lens), steps(ids), known, base))]
        out += [(b, put(steps(found[i:j]), narrow(seen[i:j]))) for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if i < j]
        texts = left.column("who")[0].values
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.full(len(out), len(texts))].astype(np.int32)), texts)
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array(np.full(len(out), chunk)), pa.array([x[1] for x in out], pa.binary()), lists], names)

    both = chunks.select("chunk", "payload", "who").groupBy("chunk").cogroup(answers.select("chunk", "bucket", "payload").groupBy("chunk"))
    return both.applyInArrow(run, f"{ROWS}, who {who}")


# Pairs: a bucket's state is its pairs and their customers, which stay, and the tables and predictives of kept sweeps.

STATE = "bucket long, pairs binary, seats binary, kept binary, once long, twice long, tables long, often array<struct<id:long,n:long>>"
_STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]
_STATE_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))]


def _state(plan: Plan, bucket: int, pairs: bytes, u: np.ndarray, count: np.ndarray, tables: np.ndarray, kept: bytes) -> pa.Table:
    hit, at = plan.is_often(u)
    sums = np.bincount(at[hit], tables[hit], len(plan.often)).astype(np.int64)
    often = [{"id": int(plan.often[k]), "n": int(sums[k])} for k in np.flatnonzero(sums)]
    row = (bucket, pairs, put(narrow(tables)), kept, int((count == 1).sum()), int((count == 2).sum()), int(tables.sum()), often)
    return pa.table([pa.array([x], t) for x, t in zip(row, _STATE_TYPES, strict=True)], _STATE_NAMES)


def merged_pairs(requests: DataFrame, plan: Plan) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        parts = [get(x) for x in table.column("payload").to_pylist()]
        code, _, count, _ = _merged([np.cumsum(p[0]) for p in parts], [wide(p[1]) for p in parts])
        return _state(plan, table.column("bucket")[0].as_py(), put(steps(code), narrow(count)), plan.split(code)[0], count, np.minimum(count, 1), b"")

    return requests.select("bucket", "payload").groupBy("bucket").applyInArrow(run, STATE)


def _words_of(plan: Plan, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different second words of some pairs, the bounds of their word buckets, and the word of each pair."""
    words, inverse = np.unique(plan.split(code)[1], return_inverse=True)
    return words, np.searchsorted(words, plan.offsets), inverse


def sent_up(state: DataFrame, plan: Plan) -> DataFrame:
    """(bucket of words, chunk = bucket of pairs, payload): words and the tables they have there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, pairs, seats in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                step, _ = get(pairs)
                words, cut, inverse = _words_of(plan, np.cumsum(step))
                tables = np.bincount(inverse, wide(get(seats)[0]), len(words)).astype(np.int64)
                out = [(b, put(narrow(steps(words[i:j] - plan.offsets[b])), narrow(tables[i:j]))) for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if i < j]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array(np.full(len(out), bucket)), pa.array([x[1] for x in out], pa.binary())], ["bucket", "chunk", "payload"])

    return state.select("bucket", "pairs", "seats").mapInArrow(run, ROWS)


# Events of three bytes: a bucket holds whole restaurants, and there are as many buckets as of words.


def _event_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix((keys // SYMBOLS).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[int]]:
    """The order of ascending events by bucket, then key, and the bounds of the buckets."""
    bucket = _event_bucket(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()


def merged_events(words: DataFrame, buckets: int) -> DataFrame:
    """(bucket, payload, once, twice): all events of the spelled words, one word for each table (before the first sweep, for
    each word that was seen), and the places of those that each bucket of words asks for."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count, size, letters, *tables = get(payload)
                keys, n = spelled_keys(letters, wide(size), wide(tables[0]) if tables else np.minimum(wide(count), 1))
                order, cut = _by_bucket(keys, buckets)
                keys, n = keys[order], n[order]
                out = [(k, put(steps(keys[i:j]), narrow(n[i:j]))) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array(np.full(len(out), b)), pa.array([x[1] for x in out], pa.binary())], ["bucket", "chunk", "payload"])

    def run(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_numpy()
        parts = [get(x) for x in table.column("payload").to_pylist()]
        keys, _, count, place = _merged([np.cumsum(p[0]) for p in parts], [wide(p[1]) for p in parts])
        payload = put(steps(keys), narrow(count), chunks, np.array([len(p[0]) for p in parts]), steps(place.astype(np.uint32)))
        row = (table.column("bucket")[0].as_py(), payload, int((count == 1).sum()), int((count == 2).sum()))
        return pa.table([pa.array([x], t) for x, t in zip(row, [pa.int64(), pa.binary(), pa.int64(), pa.int64()], strict=True)], ["bucket", "payload", "once", "twice"])

    return words.select("bucket", "payload").mapInArrow(asked, ROWS).groupBy("bucket").applyInArrow(run, "bucket long, payload binary, once long, twice long")


def events_seated(events: DataFrame, before: Spelling | None, discount: float, sweep: int) -> DataFrame:
    """The restaurants of three bytes anew, given their parents before: (bucket, chunk -1) events, shares, parents' events and
    the tables these get, and the answer to each bucket of words: the shares of its events."""
    shared = events.sparkSession.sparkContext.broadcast(pickle.dumps(before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = pickle.loads(shared.value)
        for batch in batches:
            for b, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                step, count, chunks, sizes, place = get(payload)
                keys, has = np.cumsum(step), np.flatnonzero(count)
                own = keys[has]
                parent = before.predictive(own % SYMBOLS**3, 2) if before else np.full(len(own), 1 / 257)
                level = Level(own, wide(count[has]), parent, np.random.default_rng([sweep, 3, b]), discount)
                direct, back = (x.astype(np.float32) for x in level.shares(keys))
                below, at = np.unique(own % SYMBOLS**3, return_inverse=True)
                out = [(-1, put(step, direct, back, below, np.bincount(at, level.tables, len(below)).astype(np.int64)))]
                place, ends = np.cumsum(place, dtype=np.uint32), np.cumsum(sizes)
                out += [(chunk, put(direct[place[i:j]], back[place[i:j]])) for chunk, i, j in zip(chunks.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), b)), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "chunk", "payload"])

    return events.select("bucket", "payload").mapInArrow(run, ROWS)


def _parents(seated: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The events of two bytes, ascending, and the tables that all restaurants of three bytes have for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in get(payload)[3:]], ["key", "n"])

    got = seated.filter("chunk < 0").select("payload").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = (got.column(k).to_numpy() for k in ("key", "n"))
    order = np.argsort(keys)
    return keys[order], n[order]


def words_seated(words: DataFrame, messages: DataFrame, events: DataFrame, buckets: int, spelling: Spelling, discount: float, tables: int, sweep: int) -> DataFrame:
    """The word restaurant anew: (bucket, chunk -1, seats) with its totals, and the answer to each bucket of pairs.

    The answer holds customers less discounts, and the spelled probability, as the weight of the latter is not known
    before all are seated. events: the answers of the buckets of events, which come under numbers below zero.
    """
    shared = words.sparkSession.sparkContext.broadcast(pickle.dumps(spelling))
    names = ["bucket", "chunk", "payload", "tables", "customers"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b = left.column("bucket")[0].as_py()
        count, size, letters, *before = get(left.column("payload")[0].as_py())
        rows = sorted(zip(right.column("chunk").to_pylist(), right.column("payload").to_pylist(), strict=True))
        key, begins, _ = _spelled(letters, wide(size))
        keys, inverse = np.unique(key, return_inverse=True)
        del key
        p = pickle.loads(shared.value).predictive(keys % SYMBOLS**3, 2)
        order, _ = _by_bucket(keys, buckets)
        direct, back = (np.concatenate(x) for x in zip(*(get(x) for chunk, x in reversed(rows) if chunk < 0), strict=True))
        p[order] = direct + back * p[order]
        spelled = np.add.reduceat(np.log10(p)[inverse], begins)
        del inverse, begins
        customers = np.zeros(len(count), np.int64)
        asked = []
        for chunk, payload in rows:
            if chunk < 0:
                continue
            at, n = (wide(x) for x in get(payload))
            at = np.cumsum(at)
            customers[at] += n
            asked.append((chunk, at))
        own = np.zeros(len(count), np.int64)
        has = np.flatnonzero(customers)
        last = wide(before[0])[has] if before else np.ones(len(has), np.int64)
        rng = np.random.default_rng([sweep, 1, b])
        own[has] = seat(customers[has], 10 ** np.maximum(spelled[has], -300.0), np.maximum(tables - last, 0), discount, THETA, rng)
        direct = (customers - discount * own).astype(np.float32)
        out = [(b, -1, put(count, size, letters, narrow(own)), int(own.sum()), int(customers.sum()))]
        out += [(b, chunk, put(direct[at], *_logs(spelled[at])), 0, 0) for chunk, at in asked]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()], strict=True)], names)

    answers = events.filter("chunk >= 0").select(F.col("chunk").alias("bucket"), (-1 - F.col("bucket")).alias("chunk"), "payload")
    return words.select("bucket", "payload").groupBy("bucket").cogroup(messages.union(answers).groupBy("bucket")).applyInArrow(run, f"{ROWS}, tables long, customers long")


def pairs_seated(state: DataFrame, answers: DataFrame, plan: Plan, d1: float, d2: float, tables: int, customers: int, often: np.ndarray, sweep: int, keep: bool) -> DataFrame:
    """The context restaurants anew, given the words' predictive; keep: with it and the tables among the kept sweeps."""
    back = np.log10((THETA + d1 * tables) / (THETA + customers))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket, pairs, seats, kept = (left.column(k)[0].as_py() for k in range(4))
        step, count = get(pairs)
        code, count = np.cumsum(step), wide(count)
        u, _ = plan.split(code)
        _, _, inverse = _words_of(plan, code)
        parts = [get(p) for _, p in sorted(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True))]
        direct = np.concatenate([p[0] for p in parts]).astype(np.float64)
        spelled = np.concatenate([_unlogs(*p[1:]) for p in parts])
        parent = log10_sum(log10(direct / (THETA + customers)), back + spelled)
        old = wide(get(seats)[0])
        has = np.flatnonzero(count)
        new = np.zeros(len(count), np.int64)
        others = plan.totals(u, old, often) - old
        new[has] = seat(count[has], 10 ** np.maximum(parent[inverse[has]], -300.0), np.maximum(others[has], 0), d2, THETA, np.random.default_rng([sweep, 2, bucket]))
        if keep:
            kept += struct.pack("<Q", len(more := put(narrow(new), *_logs(parent)))) + more
        return _state(plan, bucket, pairs, u, count, new, kept)

    both = state.groupBy("bucket").cogroup(answers.select(F.col("chunk").alias("to"), "bucket", "payload").groupBy("to"))
    return both.applyInArrow(run, STATE)


def probabilities(state: DataFrame, requests: DataFrame, plan: Plan, d2: float, often: list[np.ndarray]) -> DataFrame:
    """The answer to each chunk: log10 of the averaged predictives of its pairs, in the order asked. often: tables of the frequent words in each kept sweep."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs, kept = left.column("pairs")[0].as_py(), left.column("kept")[0].as_py()
        step, count = get(pairs)
        code, count = np.cumsum(step), wide(count)
        u, _ = plan.split(code)
        _, _, inverse = _words_of(plan, code)
        customers = plan.totals(u, count, plan.often_count)
        total, at, sweeps = None, 0, 0
        while at < len(kept):
            (n,) = struct.unpack_from("<Q", kept, at)
            tables, *parent = get(kept[at + 8 : at + 8 + n])
            at += 8 + n
            tables = wide(tables)
            weight = THETA + d2 * plan.totals(u, tables, often[sweeps])
            lp = log10_sum(log10(np.maximum(count - d2 * tables, 0.0)), np.log10(weight) + _unlogs(*parent)[inverse]) - np.log10(THETA + customers)
            total = lp if total is None else log10_sum(total, lp)
            sweeps += 1
        total = total - np.log10(sweeps)
        out = []
        for chunk, payload in zip(right.column("chunk").to_pylist(), right.column("payload").to_pylist(), strict=True):
            out.append((left.column("bucket")[0].as_py(), chunk, put(*_logs(total[np.searchsorted(code, np.cumsum(get(payload)[0]))]))))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.binary()], strict=True)], ["bucket", "chunk", "payload"])

    return state.groupBy("bucket").cogroup(requests.select("bucket", "chunk", "payload").groupBy("bucket")).applyInArrow(run, ROWS)


def summed(chunks: DataFrame, answers: DataFrame, plan: Plan, who: str) -> DataFrame:
    """(who, n_tokens, n_known, base_score, score) of every text."""
    kind = who.removeprefix("array<")[:-1]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place, lens, step, known, base = get(left.column("payload")[0].as_py())
        lens = wide(lens)
        _, _, inverse = plan.pairs(np.cumsum(step)[wide(place)], lens)
        order = np.argsort(right.column("bucket").to_numpy()).tolist()
        lp = np.concatenate([_unlogs(*get(right.column("payload")[k].as_py())) for k in order])
        score = np.add.reduceat(lp[inverse], np.cumsum(lens) - lens)
        return pa.table([left.column("who")[0].values, pa.array(lens), pa.array(known), pa.array(base), pa.array(score)], ["who", "n_tokens", "n_known", "base_score", "score"])

    both = chunks.select("chunk", "payload", "who").groupBy("chunk").cogroup(answers.select("chunk", "bucket", "payload").groupBy("chunk"))
    return both.applyInArrow(run, f"who {kind}, n_tokens long, n_known long, base_score double, score double")


def _often(state: DataFrame, plan: Plan) -> np.ndarray:
    """Tables in the restaurants of the frequent words."""
    rows = state.select(F.explode("often").alias("o")).groupBy("o.id").agg(F.sum("o.n").alias("n")).collect()
    found = {r.id: r.n for r in rows}
    return np.array([found.get(k, 0) for k in plan.often.tolist()], np.int64)


@dataclass
class Fitted:
    """The model and the packed texts: chunks, what they ask of the pair buckets, and these with their kept sweeps."""

    plan: Plan
    chunks: DataFrame
    asked: DataFrame
    state: DataFrame
    words: DataFrame
    discounts: tuple[float, float]
    often: list[np.ndarray]
    tables: int
    customers: int
    spelling: SpreadSpelling


def fitted(rows: DataFrame, burn_in: int = BURN_IN, kept: int = KEPT, chunk: int = CHUNK, word_bytes: int = WORD_BYTES, pair_bytes: int = PAIR_BYTES) -> Fitted:
    """The model of the rows (who, held_out, text) that aren't held out."""
    spark = rows.sparkSession
    bytes_, starts = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    word_buckets = -(-bytes_ // word_bytes) or 1
    table = materialize(packed(rows, word_buckets, chunk), "chunks", "uncompressed")
    who = table.schema["who"].dataType.simpleString()
    chunks, asked = table.filter("bucket < 0"), table.filter("bucket >= 0")
    merged = materialize(merged_words(asked), "words", "uncompressed")
    words, answers = merged.filter("chunk < 0"), merged.filter("chunk >= 0")
    sizes = sorted(words.select("bucket", "size", "tokens", "words", "once", "twice").collect())  # a row for each bucket
    offsets = np.zeros((sizes[-1].bucket if sizes else -1) + 2, np.int64)
    for r in sizes:
        offsets[r.bucket + 1] = r["size"]
    offsets = np.cumsum(offsets)
    tokens, distinct, once, twice = (sum(r[k] for r in sizes) for k in ("tokens", "words", "once", "twice"))
    pair_buckets = -(-bytes_ // pair_bytes) or 1
    least = max(2, tokens // (FREQUENT * pair_buckets))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count = wide(get(payload)[0])
                at = np.flatnonzero(count >= least)
                yield pa.RecordBatch.from_arrays([pa.array(at + offsets[b]), pa.array(count[at])], ["id", "n"])

    often = {r.id: r.n for r in words.select("bucket", "payload").mapInArrow(frequent, "id long, n long").collect()}  # FREQUENT for each bucket at most
    if starts >= least:
        often[int(offsets[-1])] = starts
    plan = Plan(offsets, tokens, distinct, pair_buckets, often)
    pairs = materialize(numbered(chunks, answers, plan, who), "pairs", "uncompressed")
    discard(table)
    release(spark)
    chunks, asked = pairs.filter("bucket < 0"), pairs.filter("bucket >= 0")
    state = materialize(merged_pairs(asked, plan), "state", "uncompressed")
    release(spark)
    n1, n2 = (x or 0 for x in state.agg(F.sum("once"), F.sum("twice")).first())
    d1, d2 = discount_of(once, twice), discount_of(n1, n2)
    rng, spelling, sums, known, tables, customers = np.random.default_rng(5), None, [], _often(state, plan), distinct, 0
    none, events = np.zeros(0, np.int64), None
    for sweep in range(burn_in + kept):
        spelled = materialize(merged_events(words, word_buckets), "events", "uncompressed")
        n1, n2 = (x or 0 for x in spelled.agg(F.sum("once"), F.sum("twice")).first())
        if events is not None:
            discard(events)
        events = materialize(events_seated(spelled, spelling, discount_of(n1, n2), sweep), "events", "uncompressed")
        discard(spelled)
        spelling = Spelling.sample(none, none, *_parents(events), spelling, rng)
        seated = materialize(words_seated(words, sent_up(state, plan), events, word_buckets, spelling, d1, tables, sweep), "words", "uncompressed")
        discard(merged)
        merged, words = seated, seated.filter("chunk < 0")
        tables, customers = (x or 0 for x in words.agg(F.sum("tables"), F.sum("customers")).first())
        nxt = materialize(pairs_seated(state, seated.filter("chunk >= 0"), plan, d1, d2, tables, customers, known, sweep, sweep >= burn_in), "state", "uncompressed")
        discard(state)
        release(spark)
        state, known = nxt, _often(nxt, plan)
        if sweep >= burn_in:
            sums.append(known)
    return Fitted(plan, chunks, asked, state, words, (d1, d2), sums, tables, customers, SpreadSpelling(spelling.levels, events, word_buckets))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, **sizes: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of docs.

    Held-out rows are scored but never trained on. A null or empty text is an end alone; repeated rows train and are
    scored each; without training rows every word is spelled by the uniform model; an empty table gives an empty result;
    other columns don't matter.
    """
    rows = id_text(docs, id_col, text_col).withColumn("held_out", held_out_expr(F.col("doc_id"), modulus, remainder))
    model = fitted(rows.select(F.struct("doc_id", "held_out").alias("who"), "held_out", "text"), **sizes)
    answers = materialize(probabilities(model.state, model.asked, model.plan, model.discounts[1], model.often), "scored", "uncompressed")
    discard(model.state)
    discard(model.spelling.events)
    release(docs.sparkSession)
    out = summed(model.chunks, answers, model.plan, model.chunks.schema["who"].dataType.simpleString())
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    return out.select("who.doc_id", "who.held_out", "n_tokens", "n_known", F.lit(model.plan.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(load(spark, sf_dir, "documents"))
