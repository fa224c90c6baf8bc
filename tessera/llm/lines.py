"""Line dedup by a segment-partition edit join.

Two short lines are near-equal if at most `tau` byte edits (insert, delete, substitute) turn one into the other; under
LEAST bytes only if equal, since two edits make another line of them. For longer lines a word is the unit of an edit:
two lines of LONG bytes or more are near-equal if at most t words are inserted, deleted or replaced, where t is two, or
one for each STRETCH words if that is more (texts of a 5-word similarity of 0.8 differ in a forty-fifth of their words).
Segments that stay unchanged find all such pairs:

* Byte edits. A line of length l is cut into tau + 1 even segments; whatever the edits, one segment of the shorter line
  stands unchanged in the longer one, near its own place. Lines file their segments under (l, segment number, bytes), and
  probe with the substrings of their own that can match a segment of a line of length l (multi-match-aware windows), for
  l from their length down to tau less.
* Word edits. Even segments and windows for more edits would outgrow the text (about t ** 3 / 3 keys of a line), so these
  lines are cut where the content says so: behind about every third word, by the word's hash. An edit spoils two segments
  at most, so near-equal lines share all but 2 t segments, and by the prefix principle one of the 2 t + 1 that come first
  in any order fixed for all lines. The order is by a coarse count, rarest first, so that a common phrase is hardly ever
  a key. A line of few different segments has a smaller t, so that 2 t + 1 of them exist; lines of fewer than MIXED
  segments go both ways.

Lines that meet under a key carry a sketch: counts of byte classes, which tau edits can change by 2 tau at most, or two
bits of the least word hash in each of 24 bins, which t edits can change in 2 t bins at most. Only pairs that pass it have
their text fetched, and are verified with a banded bit-parallel edit distance over bytes or words. Groups of a few lines
list their pairs, each to be compared once for all keys. Larger ones are dealt to blocks; every block also gets some
pivots of its group, which join the blocks of a family of copies. Lines that are then still apart are compared with all
blocks of their group, and nothing else is: no link is lost, and a family of a million copies takes a million rows. Equal
groups of different keys are one.

Exact copies are one line (by a 64-bit hash) from the start, and a task files a line that a million documents share
about once. Of each class of near-equal lines the first occurrence, by (doc_id, line number), is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, discard, load, materialize, text_buffers, trim
from tessera.llm.kernel import Hasher, mix, slices, word_bounds

TAU = 2
LEAST = 20  # shorter lines are compared exactly
LONG = 60  # from this length on, words may differ
CUT = 3  # words in a segment of a longer line, on average
STRETCH = 25  # words for each word edit
MOST_WORDS = 31  # edited words of the longest lines
MIXED = 7  # lines of fewer segments are cut evenly too
LINES = 60_000  # lines for each bucket of keys
BLOCK = 512  # lines compared at once; groups of up to a 32nd list their pairs
PIVOTS = 16
COMPARED = 1024  # lines whose pairs are held at once, or a group's if that is more
BINS = 24
INDEX, PROBE, FAR = 1, 2, 4
ROW, SLOT = -1, -2
COUNTERS = 15
SLICE = 1 << 18  # bytes of text at a time, so that its numbers stay in the cache
SLOTS, RANGES = 1 << 20, 64  # of the coarse counts
MOST_BITS = 1 << 27  # of the filter over wanted lines
SEEN_BITS = 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14)]] = True


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, number) of the lines that aren't blank, without the white space at their ends.

    number counts all line ends of the row before the line, so that it is the index in text.split(newline).
    """
    ends = np.flatnonzero(data == 10)
    s, e = np.sort(np.r_[offsets[:-1], ends + 1]), np.sort(np.r_[ends, offsets[1:]])
    s, e = s[s < e], e[s < e]
    for _ in range(32):  # white space at the ends is short, mostly
        more = np.flatnonzero(_BLANK[data[s]])
        s[more] += 1
        s, e = (s[s < e], e[s < e]) if len(more) else (s, e)
        last = np.flatnonzero(_BLANK[data[e - 1]])
        e[last] -= 1
        s, e = (s[s < e], e[s < e]) if len(last) else (s, e)
        if not len(more) + len(last):
            break
    else:
        solid = np.flatnonzero(~_BLANK[data])
        a, b = np.searchsorted(solid, s), np.searchsorted(solid, e)
        keep = b > a
        s, e = solid[a[keep]], solid[b[keep] - 1] + 1
    row = np.searchsorted(offsets, s, "right") - 1
    return s, e, row, np.searchsorted(ends, s) - np.searchsorted(ends, offsets[row])


def sketches(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Fifteen 4-bit counters (mod 16) of byte classes in bits 4 .. 63."""
    sums = np.zeros((len(s), COUNTERS), np.int64)
    size = e - s
    line = np.repeat(np.arange(len(s)), size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(s, size)
    sums = np.bincount(line * COUNTERS + data[at] % COUNTERS, minlength=len(s) * COUNTERS).reshape(-1, COUNTERS)
    out = np.zeros(len(s), np.uint64)
    for k in range(COUNTERS):
        out |= (sums[:, k] & 15).astype(np.uint64) << np.uint64(4 * k + 4)
    return out


def sketch_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.int64(0)
    for k in range(COUNTERS):
        d = (((a >> np.uint64(4 * k + 4)) - (b >> np.uint64(4 * k + 4))) & np.uint64(15)).astype(np.int64)
        out = out + np.minimum(d, 16 - d)
    return out


def segment(length: np.ndarray, i: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of segment i (from 0) of tau + 1: even, the last ones longer by one."""
    parts = tau + 1
    small, more = length // parts, length % parts
    start = i * small + np.maximum(0, i - (parts - more))
    return start, small + (i >= parts - more)


def line_keys(hasher: Hasher, s: np.ndarray, e: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(which lines, keys, role) for all segments and probes; a line's own segments are probes of length difference 0 too."""
    n = e - s

    def key(at: np.ndarray, start: np.ndarray, size: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            salt = mix(length.astype(np.uint64) * np.uint64(64) + np.uint64(i + 1))
            return mix(hasher(s[at] + start, s[at] + start + size) ^ salt)

    for delta in range(tau + 1):
        at = np.flatnonzero(n - delta >= tau + 1)
        length = n[at] - delta
        for i in range(tau + 1):
            start, size = segment(length, i, tau)
            low = max(-i, delta - (tau - i))
            high = min(i, delta + (tau - i))
            for shift in range(low, high + 1):
                ok = (start + shift >= 0) & (start + shift + size <= n[at])
                role = INDEX | PROBE if delta == 0 and shift == 0 else PROBE
                yield at[ok], key(at[ok], (start + shift)[ok], size[ok], length[ok], i), role


def word_edits(parts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Most word edits of near-equal lines, for one of them, by its different segments and its words."""
    return np.minimum(np.maximum(parts - 1, 0) // 2, np.clip(-(-words // STRETCH), 2, MOST_WORDS))


_WIDE_WORD = re.compile(rb"[\xe3-\xef][\x80-\xbf]{2}|[\xf0-\xf7][\x80-\xbf]{3}|[^\s\xe3-\xf7]+")


def split_words(line: bytes) -> list[bytes]:
    """The words of a line, as line_words cuts them."""
    return line.split() if line.isascii() or max(line) < 0xE3 else _WIDE_WORD.findall(line)


def line_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of words: runs between white space, in which each character from U+3000 on is a word of its own."""
    s, e, _ = word_bounds(data, offsets)
    wide = np.flatnonzero(data >= 0xE3)
    if len(wide):
        after = np.minimum(wide + np.where(data[wide] >= 0xF0, 4, 3), len(data))
        points = np.unique(np.r_[wide, after])
        inside = np.searchsorted(s, points, "left") - 1  # the last word that begins before
        points = points[(inside >= 0) & (points < e[np.maximum(inside, 0)])]
        s, e = np.sort(np.r_[s, points]), np.sort(np.r_[e, points])
    return s, e


def segments(hasher: Hasher, s: np.ndarray, e: np.ndarray, ws: np.ndarray, we: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line and key of every content-cut segment, words of each line, and line and hash of every word.

    s, e: lines in ascending order; ws, we: the words of the text, of which those of other lines are left out.
    """
    low = np.searchsorted(ws, s)
    count = np.searchsorted(ws, e) - low
    line = np.repeat(np.arange(len(s)), count)
    own = np.arange(len(line)) + np.repeat(low - (np.cumsum(count) - count), count)
    ws, we = ws[own], we[own]
    words = hasher(ws, we)
    last = np.r_[line[1:] != line[:-1], True] if len(line) else np.zeros(0, bool)
    end = np.flatnonzero(last | ((words >> np.uint64(40)) % np.uint64(CUT) == 0))
    begin = np.r_[0, end[:-1] + 1] if len(end) else end
    return line[end], mix(hasher(ws[begin], we[end]) ^ np.uint64(0xA24BAED4963EE407)), count, line, words


def slot_of(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(SLOTS - 1)).astype(np.int64)


def far_keys(hasher: Hasher, s: np.ndarray, e: np.ndarray, ws: np.ndarray, we: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, key) of the 2 t + 1 first segments of each line, by level; the sketches, and the number of segments, of all lines."""
    line, keys, count, word_line, words = segments(hasher, s, e, ws, we)
    order = np.lexsort((keys, levels[slot_of(keys)], line))
    line, keys = line[order], keys[order]
    fresh = np.r_[True, (line[1:] != line[:-1]) | (keys[1:] != keys[:-1])] if len(line) else np.zeros(0, bool)
    line, keys = line[fresh], keys[fresh]
    parts = np.bincount(line, minlength=len(s))
    t = np.where(e - s >= LONG, word_edits(parts, count), 0)
    rank = np.arange(len(line)) - (np.cumsum(parts) - parts)[line]
    keep = (t[line] > 0) & (rank < 2 * t[line] + 1)
    least = np.full(len(s) * BINS, ~np.uint64(0))
    at = word_line * BINS + ((words >> np.uint64(32) & np.uint64(0xFFFF)) * np.uint64(BINS) >> np.uint64(16)).astype(np.int64)
    np.minimum.at(least, at, mix(words))
    least = least.reshape(-1, BINS) >> np.uint64(8) & np.uint64(3)
    sketch = (count & 127).astype(np.uint64) << np.uint64(9) | t.astype(np.uint64) << np.uint64(4) | np.uint64(FAR)
    for k in range(BINS):
        sketch |= least[:, k] << np.uint64(16 + 2 * k)
    return line[keep], keys[keep], sketch, parts


def edits_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most word edits of two longer lines, from their sketches."""
    return np.minimum(a >> np.uint64(4) & np.uint64(31), b >> np.uint64(4) & np.uint64(31)).astype(np.int64)


def far_close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sketches of longer lines allow near-equal ones: an edited word changes two bins at most."""
    t = edits_of(a, b)
    more = ((a >> np.uint64(9)) - (b >> np.uint64(9)) & np.uint64(127)).astype(np.int64)
    d = (a ^ b) >> np.uint64(16)
    differ = np.bitwise_count((d | d >> np.uint64(1)) & np.uint64(0x555555555555)).astype(np.int64)
    return (np.minimum(more, 128 - more) <= t) & (differ <= 2 * t)


def may_be_near(a: np.ndarray, b: np.ndarray, tau: int) -> np.ndarray:
    """Whether the sketches of two lines that meet under a key allow them to be near-equal."""
    far = (a & b & np.uint64(FAR)) > 0
    if far.all():
        return far_close(a, b)
    near = sketch_distance(a, b) <= 2 * tau
    return np.where(far, far_close(a, b), near) if far.any() else near


def edits_within(a: Sequence, b: Sequence, most: int) -> bool:
    """Whether the edit distance of two byte strings, or of two lists of words, is at most `most`: bit-parallel (Hyyro), in a band."""
    if abs(len(a) - len(b)) > most:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # length of the common beginning
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[len(a) - mid : len(a) - lo] == b[len(b) - mid : len(b) - lo] else (lo, mid - 1)
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    if len(a) > len(b):
        a, b = b, a
    if len(b) <= most:
        return True
    rows = len(a)
    if rows <= most:  # no band to speak of: a table of few rows
        row = list(range(rows + 1))
        for j, c in enumerate(b, 1):
            last, row[0] = row[0], j
            for k in range(1, rows + 1):
                last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (a[k - 1] != c))
        return row[rows] <= most
    # Bit k of the masks is row j + k - most of column j, for the 2 * most + 1 diagonals of the band.
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    masks: dict = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << (k + most)
    vp, vn, distance = full ^ ((1 << most) - 1), 0, most
    # distance is that of the band's last row, until the band reaches the last row of all and moves along it.
    for j, c in enumerate(b):
        pm = masks.get(c, 0) >> j & full
        d0 = ((((pm & vp) + vp) ^ vp) | pm | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j + most < rows:
            distance += not d0 & top
        else:
            bit = width - 2 - (j + most - rows)
            distance += (hp >> bit & 1) - (hn >> bit & 1)
        if distance > 2 * most + len(b) - rows:
            return False
        x = d0 >> 1
        vp, vn = (hn | ~(x | hp)) & full, x & hp
    return distance <= most


def script_within(x: list[bytes], y: list[bytes], most: int) -> bool:
    """Whether the script of edits that takes, from the left, the least skip to two equal words has at most `most` edits."""
    i = j = done = 0
    n, m = len(x), len(y)
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for di, dj in _SKIPS:
            if x[i + di : i + di + 2] == y[j + dj : j + dj + 2]:
                break
        else:
            return False
        done += max(di, dj)
        if done > most:
            return False
        i, j = i + di, j + dj
    return done + max(n - i, m - j) <= most


_SKIPS = [(1, 1), (0, 1), (1, 0), (2, 2), (1, 2), (2, 1), (0, 2), (2, 0)]


def near_equal(a: bytes, b: bytes, tau: int, t: int) -> bool:
    """Whether at most t word edits lie between two lines, or tau byte edits if t is 0."""
    if not t:
        return edits_within(a, b, tau)
    x, y = split_words(a), split_words(b)
    if abs(len(x) - len(y)) > t:
        return False
    if script_within(x, y, t):
        return True
    # Each edit takes away one word at most, and brings in one.
    p, q = set(x), set(y)
    return len(p - q) <= t and len(q - p) <= t and edits_within(x, y, t)


def word_bits(lines: pa.Array) -> np.ndarray:
    """A set of 1024 bits for the words of each line, [lines, 16]."""
    out = np.zeros((len(lines), 16), np.uint64)
    for lo, _, data, at in slices(*text_buffers(lines), SLICE):
        s, e = line_words(data, at)
        slot = (Hasher(data)(s, e) >> np.uint64(20) & np.uint64(1023)).astype(np.int64)
        np.bitwise_or.at(out, (np.searchsorted(at, s, "right") - 1 + lo, slot >> 6), np.uint64(1) << (slot & 63).astype(np.uint64))
    return out


def words_allow(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether the words of two lines allow t edits: each takes away one word at most, and brings in one."""
    return (np.bitwise_count(a & ~b).sum(axis=1) <= t) & (np.bitwise_count(b & ~a).sum(axis=1) <= t)


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """(rkey, doc_id, no, id, counts) of every line that isn't blank; rkey names the row by its id and text.

    Two more kinds of rows: no = ROW, one for each row of docs, with its number of lines as id; no = SLOT, a task's counts
    of segments of longer lines in the slots of range id, compressed (up to 65535 of each).
    """
    rows = keyed_rows(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        names = ["rkey", "doc_id", "no", "id", "counts"]
        batch = None
        for batch in batches:
            for lo, hi, data, at in slices(*text_buffers(batch.column("text")), SLICE):
                s, e, row, number = line_bounds(data, at)
                take = pa.array(row + lo)
                hasher = Hasher(data)
                ids = hasher(s, e)
                yield pa.RecordBatch.from_arrays([batch.column("rkey").take(take), batch.column("doc_id").take(take), pa.array(number.astype(np.int32)), pa.array(ids.view(np.int64)), pa.nulls(len(ids), pa.binary())], names)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(lo, hi - lo) for k in ("rkey", "doc_id")] + [pa.array(np.full(hi - lo, ROW, np.int32)), pa.array(np.bincount(row, minlength=hi - lo)), pa.nulls(hi - lo, pa.binary())], names)
                few = e - s < 4 * LONG
                for _, keys, role in line_keys(hasher, s[few], e[few], tau):  # of lines that may be cut evenly
                    if role & INDEX:
                        np.add.at(total, slot_of(keys), 1)
                s, e = s[e - s >= LONG], e[e - s >= LONG]
                np.add.at(total, slot_of(segments(hasher, s, e, *line_words(data, at))[1]), 1)
        if batch is not None:
            squeeze = zstandard.ZstdCompressor(3)
            blobs = [squeeze.compress(part.tobytes()) for part in np.minimum(total, 65535).astype("<u2").reshape(RANGES, -1)]
            trim()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(RANGES, np.int64)), pa.nulls(RANGES, batch.schema.field("doc_id").type), pa.array(np.full(RANGES, SLOT, np.int32)), pa.array(np.arange(RANGES)), pa.array(blobs, pa.binary())], names)

    return rows.mapInArrow(run, f"rkey long, doc_id {kind}, no int, id long, counts binary")


def levels_of(found: DataFrame) -> np.ndarray:
    """A coarse count of segments: four times log2 of those in each slot.

    Only the order of a line's keys depends on it, and any order will do, as long as it is the same for all lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u2").astype(np.int64)
                totals[k] = totals[k] + counts if k in totals else counts
        levels = [(4 * np.log2(x + 1)).astype(np.uint8).tobytes() for x in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(levels, pa.binary())], ["id", "levels"])

    rows = found.filter(F.col("no") == SLOT).select("id", "counts").repartition("id").mapInArrow(run, "id long, levels binary").collect()
    out = np.zeros(SLOTS, np.uint8).reshape(RANGES, -1)
    for r in rows:
        out[r.id] = np.frombuffer(bytes(r.levels), np.uint8)
    return out.ravel()


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(F.col(id_col), text).alias("rkey"), F.col(id_col).alias("doc_id"), text.alias("text"))


FILED = 1 << 17  # rows that a filing task holds before it passes them on


def _filed(docs: DataFrame, text_col: str, levels: np.ndarray, buckets: int, hot: int, tau: int, least: int) -> DataFrame:
    """(bucket, payload): keys, ids and sketches of lines by buckets of keys, eight bytes each, one list after the other.

    The low four bits of a sketch hold the role. Copies within a slice are one, and so are nearly all within a task. Rows
    whose key has a level of `hot` or more go to buckets from `buckets` on, by their id, so that no bucket holds them all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(shared.value, np.uint8)
        filed = np.zeros(1 << SEEN_BITS, np.uint64)  # the last line of each slot, so that a hot line is filed about once a task
        filed[0] = 1
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            key, ids, sketch = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
            often = levels[slot_of(key)] >= hot
            bucket[often] = buckets + (mix(ids[often]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 15 else bucket, kind="stable")
            rows = np.stack([key[order], ids[order], sketch[order]])
            first = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0])
            parts = [rows[:, i:j].tobytes() for i, j in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[order][first]), pa.array(parts, pa.binary())], ["bucket", "payload"])

        for batch in batches:
            for _, _, data, at in slices(*text_buffers(batch.column(0)), SLICE):
                s, e, _, _ = line_bounds(data, at)
                long_ = e - s >= least
                s, e = s[long_], e[long_]
                hasher = Hasher(data)
                ids, first = np.unique(hasher(s, e), return_index=True)
                slot = (ids & np.uint64((1 << SEEN_BITS) - 1)).astype(np.int64)
                fresh = filed[slot] != ids
                filed[slot] = ids
                first = np.sort(first[fresh])
                s, e = s[first], e[first]
                ids = hasher(s, e)
                line, keys, sketch, parts = far_keys(hasher, s, e, *line_words(data, at), levels)
                fresh_rows = [(keys, ids[line], sketch[line])]
                short = (parts < MIXED) | (e - s < LONG)
                s, e, ids = s[short], e[short], ids[short]
                sketch = sketches(data, s, e)
                fresh_rows += [(keys, ids[which], sketch[which] | np.uint64(role)) for which, keys, role in line_keys(hasher, s, e, tau)]
                held += fresh_rows
                n += sum(len(x[0]) for x in fresh_rows)
                if n >= FILED:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()
        held = []
        trim()

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "bucket long, payload binary")


def _tables(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole groups, of `rows` rows or somewhat more; a larger group stands in one."""
    kept: list[pa.Table] = []
    held = 0
    for batch in (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows)):
        if not batch.num_rows:
            continue
        kept.append(pa.Table.from_batches([batch]))
        held += batch.num_rows
        if held < rows:
            continue
        table = pa.concat_tables(kept)
        same = np.ones(table.num_rows, bool)
        for k in keys:
            c = table.column(k).to_numpy()
            same &= c == c[-1]
        other = np.flatnonzero(~same)
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield table.slice(0, cut)
        kept, held = [table.slice(cut)], held - cut
    if held:
        yield pa.concat_tables(kept)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the runs of equal keys, and their ends."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return first, np.r_[first[1:], len(keys)]


def _members(key: np.ndarray, ids: np.ndarray, sketch: np.ndarray, tau: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the rows of whole groups: the pairs (id, id, 16 * t) of small groups whose sketches allow near-equal lines, and the rows of larger groups.

    A larger group is named by the set of its lines, so that the same group of another key is no other one. Of a group of
    up to `block` lines only members of pairs stay.
    """
    order = np.lexsort((ids, key))
    key, ids, sketch = key[order], ids[order], sketch[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])])
    sketch = np.bitwise_or.reduceat(sketch, first)
    key, ids = key[first], ids[first]
    g, end = _groups(key)
    size = end - g
    last = np.repeat(end, size)
    good = np.repeat(size > block, size)
    listed = np.repeat(size <= block // 32, size)
    at, shift = np.flatnonzero(np.repeat((size > 1) & (size <= block), size)), 1
    while True:
        at = at[at + shift < last[at]]
        if not len(at):
            break
        a, b = sketch[at], sketch[at + shift]
        met = ((a & np.uint64(INDEX)) & ((b >> np.uint64(1)) & np.uint64(1))) | ((b & np.uint64(INDEX)) & ((a >> np.uint64(1)) & np.uint64(1)))
        hit = at[((met > 0) | ((a & b & np.uint64(FAR)) > 0)) & may_be_near(a, b, tau)]
        pair = hit[listed[hit]]
        if len(pair):
            x, y = ids[pair].view(np.int64), ids[pair + shift].view(np.int64)
            t = np.where(sketch[pair] & np.uint64(FAR), edits_of(sketch[pair], sketch[pair + shift]), 0) * 16
            yield np.minimum(x, y), np.maximum(x, y), t
        hit = hit[~listed[hit]]
        good[hit] = good[hit + shift] = True
        shift += 1
    good = np.flatnonzero(good)
    if len(good):
        key, ids, sketch = key[good], ids[good], sketch[good]
        g, end = _groups(key)
        with np.errstate(over="ignore"):
            name = np.repeat(np.add.reduceat(mix(ids), g), end - g)
        yield name.view(np.int64), ids.view(np.int64), sketch.view(np.int64)


def _met(table: pa.Table, buckets: int, tau: int, block: int) -> pa.Table:
    """The members of a bucket; all rows of a bucket of hot keys, under their keys."""
    rows = np.concatenate([np.frombuffer(x, np.uint64).reshape(3, -1) for x in table.column("payload").to_pylist()], axis=1)
    if table.column("bucket")[0].as_py() >= buckets:
        out = [tuple(x.view(np.int64) for x in np.unique(rows, axis=1))]
    else:
        out = list(_members(*rows, tau, block))
    none, rows = np.empty(0, np.int64), None
    out = pa.table([pa.array(np.concatenate([none, *(x[k] for x in out)])) for k in range(3)], names=["key", "id", "sketch"])
    trim()
    return out


def _filter_words(ids: DataFrame) -> np.ndarray:
    """A bitmap over the hashes of ids, of 16 bits for each but MOST_BITS at most: beyond, more lines pass that aren't wanted."""
    size = min(MOST_BITS, 1 << max(16, int(16 * ids.count()).bit_length()))
    slot = F.col("id").bitwiseAND(size - 1)
    bits = ids.select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(size >> 6, np.uint64)
    got = bits.toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def _texts(docs: DataFrame, text_col: str, ids: DataFrame, least: int) -> DataFrame:
    """(id, line) of the lines whose id is in ids."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_words(ids).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(shared.value, np.uint64)
        sent = np.zeros(1 << SEEN_BITS, np.uint64)
        sent[0] = 1
        for batch in batches:
            out_ids, out_lines = [], []
            for _, _, data, at in slices(*text_buffers(batch.column(0)), SLICE):
                s, e, _, _ = line_bounds(data, at)
                long_ = e - s >= least
                s, e = s[long_], e[long_]
                found, first = np.unique(Hasher(data)(s, e), return_index=True)
                slot = found & np.uint64(64 * len(wanted) - 1)
                hit = (wanted[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
                own = (found & np.uint64((1 << SEEN_BITS) - 1)).astype(np.int64)
                hit &= sent[own] != found
                sent[own[hit]] = found[hit]
                out_ids += found[hit].view(np.int64).tolist()
                out_lines += [data[a:b].tobytes() for a, b in zip(s[first[hit]], e[first[hit]], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out_lines, pa.binary())], ["id", "line"])
        trim()

    lines = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "id long, line binary")
    return lines.join(ids, "id", "left_semi").groupBy("id").agg(F.min("line").alias("line"))


def _candidates(sketch: np.ndarray, guest: np.ndarray, cross: bool, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a group whose sketches pass, by i; cross: of a guest and another."""
    a, b = (np.flatnonzero(guest), np.flatnonzero(~guest)) if cross else (np.arange(len(sketch)),) * 2
    out_i, out_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(0, len(a), 256):
        near = may_be_near(sketch[a[k : k + 256], None], sketch[None, b], tau)
        if not cross:
            near &= a[k : k + 256, None] > b[None, :]
        i, j = np.nonzero(near)
        out_i.append(a[k + i])
        out_j.append(b[j])
    return np.concatenate(out_i), np.concatenate(out_j)


def _verified(batches: Iterator[pa.RecordBatch], tau: int, cross: bool) -> Iterator[pa.RecordBatch]:
    """Spanning links of the near-equal pairs, by group (key, block, part).

    In each round every line is tried against its next candidate in another class; classes that a pair joins are one from
    then on, so that a family of copies takes a round or two.
    """
    for table in _tables(batches, ["key", "block", "part"], COMPARED):
        links = _table_links(table, tau, cross)
        if links:
            left, right = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
    table = None
    trim()


def _table_links(table: pa.Table, tau: int, cross: bool) -> list[tuple[int, int]]:
    keys = ["key", "block", "part"]
    cols = [table.column(k).to_numpy() for k in keys]
    ids, sketch, root, guest = (table.column(k).to_numpy(zero_copy_only=False) for k in ("id", "sketch", "root", "guest"))
    sketch = sketch.view(np.uint64)
    change = np.zeros(len(ids), np.int64)
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    group = np.cumsum(change)
    label = np.unique(np.c_[group, root], axis=0, return_inverse=True)[1].ravel()
    pairs = [(x + a, y + a) for a, b in zip(*_groups(group), strict=True) if b - a > 1 for x, y in [_candidates(sketch[a:b], guest[a:b], cross, tau)]]
    if not pairs:
        return []
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    edits = np.where(sketch[i] & sketch[j] & np.uint64(FAR), edits_of(sketch[i], sketch[j]), 0)
    bits = word_bits(table.column("line").combine_chunks())
    ok = np.concatenate([(edits[k : k + 50_000] == 0) | words_allow(bits[i[k : k + 50_000]], bits[j[k : k + 50_000]], edits[k : k + 50_000]) for k in range(0, len(i), 50_000)] or [edits > 0])
    i, j, edits = i[ok], j[ok], edits[ok]
    lines = table.column("line").to_pylist()
    links: list[tuple[int, int]] = []
    while True:
        open_ = (label[i] != label[j]) & (ids[i] != ids[j])
        i, j, edits = i[open_], j[open_], edits[open_]
        if not len(i):
            break
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        x, y = i[first], j[first]
        for p, q, most in zip(x.tolist(), y.tolist(), edits[first].tolist(), strict=True):
            if label[p] != label[q] and near_equal(lines[p], lines[q], tau, most):
                links.append((ids[p], ids[q]))
                label[label == label[q]] = label[p]
        rest = np.ones(len(i), bool)
        rest[first] = False
        i, j, edits = i[rest], j[rest], edits[rest]
    return links


def _compared(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, t, text of a, text of b) that are near-equal."""
    for batch in batches:
        t = batch.column(2).to_numpy()
        maybe = (t == 0) | words_allow(word_bits(batch.column(3)), word_bits(batch.column(4)), t)
        good = pa.array([ok and near_equal(x, y, tau, n) for ok, n, x, y in zip(maybe.tolist(), *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in (0, 1)], ["a", "b"])
    batch = t = maybe = good = None
    trim()


def near_lines(docs: DataFrame, levels: np.ndarray, lines: int, text_col: str = "text", tau: int = TAU, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(a, b): links between ids of different near-equal lines, enough to join all that is reachable. lines: about how many there are."""
    buckets = max(64, lines // LINES)
    # A key far over the others, or over many blocks; levels are 4 * log2.
    hot = int(4 * np.log2(max(32 * block, 8 * 2 ** (levels / 4.0).mean()) + 1))
    filed = _filed(docs, text_col, levels, buckets, hot, tau, least)
    found = materialize(filed.groupBy("bucket").applyInArrow(lambda x: _met(x, buckets, tau, block), "key long, id long, sketch long"), "members")
    # Two lines may meet under a key of bytes and under one of words: then either will do.
    pairs = materialize(found.filter("sketch & 15 = 0").select(F.col("key").alias("a"), F.col("id").alias("b"), (F.col("sketch") / 16).cast("int").alias("t")).distinct(), "pairs")
    members = materialize(found.filter("sketch & 15 <> 0").groupBy("key", "id").agg(F.bit_or("sketch").alias("sketch")), "members")
    discard(found)
    wanted = materialize(members.select("id").union(pairs.select("a")).union(pairs.select("b")).distinct(), "wanted")
    texts = materialize(_texts(docs, text_col, wanted, least), "texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("left")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("right")), "b")
    links = both.select("a", "b", "t", "left", "right").mapInArrow(lambda it: _compared(it, tau), "a long, b long")
    schema, no = "a long, b long", F.lit(False).alias("guest")

    def verified(rows: DataFrame, cross: bool) -> DataFrame:
        rows = rows.join(texts, "id").repartition("key", "block", "part").sortWithinPartitions("key", "block", "part")
        return rows.mapInArrow(lambda it: _verified(it, tau, cross), schema)

    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    large = placed.filter("blocks > 1")
    # A few lines of each large group, the same whatever the order of rows, go to all its blocks.
    pivots = large.groupBy("key", "blocks", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PIVOTS)).alias("of")).agg(F.min(F.struct(F.xxhash64("id", F.lit(2)), "id", "sketch", "block")).alias("p"))
    pivots = pivots.select("key", "p.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("to")).filter("to <> block")
    columns = ("key", "id", "sketch", "block")
    first = placed.select(*columns).union(pivots.select("key", "id", "sketch", "to"))
    links = materialize(links.union(verified(first.withColumn("part", F.lit(0).cast("long")).withColumn("root", F.col("id")).withColumn("guest", F.lit(False)), False)).distinct(), "links")
    if large.isEmpty():
        for done in (pairs, members, wanted, texts):
            discard(done)
        return links
    roots = materialize(components(links), "roots")
    named = materialize(large.join(roots, large.id == roots.node, "left").select(*columns, "blocks", F.coalesce("root", "id").alias("root")), "named")
    classes_ = named.groupBy("key", "root").agg(F.count("*").alias("n"))
    top = classes_.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.ceil((F.sum("n") - F.max("n")) / block).alias("parts")).filter("parts > 0")
    apart = named.join(top, "key")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    home = apart.select(*columns, every("parts").alias("part"), "root", no)
    guests = apart.filter("root <> top").withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")))
    guests = guests.select("key", "id", "sketch", every("blocks").alias("block"), "part", "root", F.lit(True).alias("guest"))
    out = materialize(links.union(verified(home.union(guests), True)).distinct(), "links")
    for done in (pairs, members, wanted, texts, links, roots, named):
        discard(done)
    return out


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, least: int = LEAST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All occurrences, and (rkey, no, near) of the lines to drop: all but the first of each class.

    near tells a line whose own text first occurs here, dropped for a near-equal one, from an exact copy.
    """
    found = materialize(occurrences(docs, id_col, text_col, tau), "lines")
    links = near_lines(docs, levels_of(found), found.count(), text_col, tau, least, block)
    roots = materialize(components(links), "roots")
    discard(links)
    place = F.struct("doc_id", "rkey", "no")
    named = found.filter("no >= 0").join(roots, F.col("id") == F.col("node"), "left").select("rkey", "doc_id", "no", "id", F.coalesce("root", "id").alias("root"))
    # Most lines are alone in their class; they go once the classes are counted.
    kept = named.groupBy("root").agg(F.min(place).alias("kept"), F.count("*").alias("total"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("total > 1")
    kept = materialize(kept, "kept")  # else the join would take place where a class is counted, which can't be split
    drop = named.join(kept.select("root", "kept", (F.col("lo") != F.col("hi")).alias("several")), "root").filter(place != F.col("kept"))
    drop = materialize(drop.select("rkey", "doc_id", "no", "id", "kept", "several"), "drop")
    discard(roots)
    discard(kept)
    first = drop.filter("several").groupBy("id").agg(F.min(place).alias("first"), F.min("kept").alias("kept")).filter("first > kept")
    # The kept line's own text has its first place there; its further copies are exact ones.
    origin = drop.filter("several").select("kept").distinct().join(found.filter("no >= 0").select("id", place.alias("kept")), "kept").select(F.col("id").alias("origin"))
    first = first.join(origin, F.col("id") == F.col("origin"), "left_anti").select("id", "first")
    first = materialize(first, "first")  # apart from the join, as above
    marked = drop.join(first, "id", "left")
    return found, marked.select("rkey", "no", F.coalesce(place == F.col("first"), F.lit(False)).alias("near"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """docs with its own columns, each text without the lines to drop; other lines and blank ones stay as they are.

    A null text stays null, a text all of whose lines go becomes empty. Rows equal in id and text count as one.
    """
    _, drop = dropped_lines(docs, id_col, text_col, tau, least, block)
    gone = drop.groupBy("rkey").agg(F.collect_set("no").alias("__gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.xxhash64(F.col(id_col), text).alias("rkey"))
    whole = F.col(f"__row.{text_col}")

    @F.pandas_udf("string")
    def without(texts, gone):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for x, nos in zip(texts, gone, strict=True):
            drop = set() if nos is None else set(nos.tolist())
            out.append("\n".join([line for no, line in enumerate(x.split("\n")) if no not in drop]) if drop else x)
        return pd.Series(out, dtype=object)

    out = rows.join(gone, "rkey", "left")
    cut = F.when(F.col("__gone").isNull(), whole).otherwise(without(whole, "__gone"))
    return out.select(*((cut if c == text_col else F.col("__row")[c]).alias(c) for c in docs.columns))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, dropped (sorted line numbers, comma-joined) for every row of docs.

    Blank lines don't count. A null or empty text has no lines; an empty table gives an empty result; repeated rows
    have equal results; a null id sorts first.
    """
    found, drop = dropped_lines(docs, id_col, text_col, tau, least, block)
    gone = drop.groupBy("rkey").agg(F.collect_set(F.struct("no", "near")).alias("gone"))
    rows = found.filter(F.col("no") == ROW).select("rkey", "doc_id", F.col("id").alias("n_lines")).join(gone, "rkey", "left")
    count = lambda near: F.coalesce(F.size(F.filter("gone", lambda g: g["near"] == near)), F.lit(0)).cast("long")
    dropped = F.array_join(F.transform(F.array_sort("gone"), lambda g: g["no"].cast("string")), ",")
    return rows.select(
        "doc_id", "n_lines", F.when(F.col("gone").isNull(), F.lit(0)).otherwise(count(False)).cast("long").alias("n_exact"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(count(True)).cast("long").alias("n_near"), F.coalesce(dropped, F.lit("")).alias("dropped"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(load(spark, sf_dir, "documents"))
