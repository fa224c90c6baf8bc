"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, units and names turn into the typed placeholders NUM, UNIT and NAME, all other words
stay, in lower case. A name is a capitalised word inside a sentence, and every other place of that word in the text.
Windows of five template words are hash-joined with those of the benchmark items, so a question with other numbers or
names still meets its original. A document contains an item if at least 0.8 of the item's different windows occur in it,
and if its slots are consistent: nearly every slot value of the item must always stand for the same value in the document
(0.8 of all slot places), as it does in a re-parameterised question and not in text that merely has the same shape.
(Different values may become equal, since a question may use a number twice.) Consistency is that of one occurrence:
windows of document and item are aligned by their positions, so that neither a second question of the same template nor a
window that recurs in the item counts against it; only an item whose windows lie scattered is judged over the whole
document. Template windows of fewer than two plain words are no evidence and are left out on both sides.

Each item has a second set of windows, of its lower-case words as they stand. It finds copies in other case, and items
that are all numbers; the better set counts. An item of fewer than five words has one such window, of all its words, and
is contained where that window stands by itself, between line ends or marks that end a sentence.

Only the rarest windows of an item look for documents (as many as must hold one of any 0.8 of its windows), so that a
phrase shared by all items doesn't pair every item with every document; the pairs found are then counted in full.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import load, materialize, text_buffers
from tessera.llm.kernel import Hasher, mix, slices, word_bounds

WORDS = 5
SIMILARITY = 0.8
BROADCAST_WINDOWS = 1 << 20  # most benchmark windows that are sent to the executors (8 MB); beyond, a bitmap of them alone
MOST_BITS = 1 << 27

# Units and number words that become placeholders.
UNITS = """mm cm m km meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards
mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds ml l liter liters litre litres gallon gallons
second seconds minute minutes hour hours day days week weeks month months year years percent degree degrees dollar dollars cent cents
euro euros usd eur gbp kmh mph volt volts watt watts joule joules newton newtons byte bytes kb mb gb tb""".split()
NUMBERS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split()
LITERAL, NUM, UNIT, NAME = range(4)

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?:;\n\"|"]] = True


@lru_cache(maxsize=2)
def _hashes(kind: int) -> np.ndarray:
    words = [w.encode() for w in (UNITS if kind == UNIT else NUMBERS)]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.sort(Hasher(data)(np.r_[0, ends[:-1]], ends))


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def template_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, type, hash of the lower-case word) of the words of some rows."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, np.empty(0, np.uint64)
    # A point or comma between digits is part of the number: it reads as a digit for the cutting alone.
    cut = data
    mark = np.flatnonzero((data == 46) | (data == 44))
    mark = mark[(mark > 0) & (mark < len(data) - 1)]
    mark = mark[_DIGIT[data[mark - 1]] & _DIGIT[data[mark + 1]]]
    if len(mark):
        cut = data.copy()
        cut[mark] = 48
    s, e, row = word_bounds(cut, offsets, _SEPARATOR)
    low = _LOWER[data]
    latin = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    low[latin] += 32
    values = Hasher(low)(s, e)
    kind = np.zeros(len(s), np.int64)
    first, second = data[s], data[np.minimum(s + 1, len(data) - 1)]
    breaks = np.r_[0, np.cumsum(_BREAK[data])]
    inside = np.zeros(len(s), bool)
    inside[1:] = (row[1:] == row[:-1]) & (breaks[s[1:]] == breaks[e[:-1]])
    capital = (first >= 65) & (first <= 90) & (e - s > 1) & (second >= 97) & (second <= 122)
    own = values ^ mix(row.astype(np.uint64))
    names = np.unique(own[inside & capital])
    if len(names):
        kind[capital & _in(own, names)] = NAME
    kind[_in(values, _hashes(UNIT))] = UNIT
    kind[_DIGIT[first] | _in(values, _hashes(NUM))] = NUM
    return s, e, row, kind, values


def windows(data: np.ndarray, offsets: np.ndarray, short: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window hash, first word, row, words, whether literal) of the windows that are evidence, and (start, end, type) of all words.

    short: sizes under WORDS of the literal windows asked for that stand by themselves.
    """
    s, e, row, kind, values = template_words(data, offsets)
    found = [(np.empty(0, np.uint64), np.empty(0, np.int64), WORDS, False)]

    def hashed(x: np.ndarray, size: int) -> np.ndarray:
        out = np.full(len(x) - size + 1, size, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                out = (out + x[k : k + len(out)]) * np.uint64(0xD1342543DE82EF95)
        return mix(out)

    n = len(s) - WORDS + 1
    if n > 0:
        plain = np.where(kind == LITERAL, values, mix(kind.astype(np.uint64) + np.uint64(1000)))
        literals = np.r_[0, np.cumsum(kind == LITERAL)]
        whole = row[:n] == row[WORDS - 1 :]
        at = np.flatnonzero(whole & (literals[WORDS:] - literals[:n] >= 2))
        found.append((hashed(plain, WORDS)[at], at, WORDS, False))
        at = np.flatnonzero(whole)
        found.append((hashed(values ^ np.uint64(0x2545F4914F6CDD1D), WORDS)[at], at, WORDS, True))
    for size in short:
        if len(s) >= size:
            breaks = np.r_[0, np.cumsum(_BREAK[data])]
            edge = np.ones(len(s) + 1, bool)  # whether something ends before each word
            edge[1:-1] = (row[1:] != row[:-1]) | (breaks[s[1:]] != breaks[e[:-1]])
            at = np.flatnonzero(edge[: len(s) - size + 1] & edge[size:] & (row[: len(s) - size + 1] == row[size - 1 :]))
            found.append((hashed(values ^ np.uint64(0x2545F4914F6CDD1D), size)[at], at, size, True))
    at, each = np.concatenate([x[1] for x in found]), [len(x[1]) for x in found]
    return np.concatenate([x[0] for x in found]), at, row[at], np.repeat([x[2] for x in found], each), np.repeat([x[3] for x in found], each), (s, e, kind)


def _slots(data: np.ndarray, at: int, s: np.ndarray, e: np.ndarray, kind: np.ndarray) -> list[str]:
    return [data[s[k] : e[k]].tobytes().decode("utf-8", "replace").lower() for k in range(at, at + WORDS) if kind[k] != LITERAL]


def _window_rows(rows: DataFrame, wanted: np.ndarray | None, bits: np.ndarray | None = None, short: tuple[int, ...] | None = None) -> DataFrame:
    """(key, win, words, literal, place, slots): windows of each text, the number of their first word and the values of their placeholders.

    wanted: the windows looked for, all if None; bits: a bitmap over the hashes of the windows looked for, where those are
    too many. short: sizes of literal windows under WORDS; None: for texts that have only so many words, that size.
    """
    kind = rows.schema["key"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((None if wanted is None else wanted.tobytes(), None if bits is None else bits.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = (None if x is None else np.frombuffer(x, np.uint64) for x in shared.value)
        if known is not None:
            seen = np.zeros(1 << 16, np.uint64)
            slot = known & np.uint64((1 << 22) - 1)
            np.bitwise_or.at(seen, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        for batch in batches:
            for lo, _, data, at in slices(*text_buffers(batch.column(1))):
                win, first, row, words, literal, (s, e, types) = windows(data, at, tuple(range(1, WORDS)) if short is None else short)
                begin = np.searchsorted(s, at)  # first word of each row
                if short is None:
                    own = words == np.minimum(np.diff(begin)[row], WORDS)
                    win, first, row, words, literal = win[own], first[own], row[own], words[own], literal[own]
                if seen is not None:
                    slot = win & np.uint64(64 * len(seen) - 1)
                    maybe = np.flatnonzero(seen[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
                    if known is not None:
                        maybe = maybe[_in(win[maybe], known)] if len(known) else maybe[:0]
                    win, first, row, words, literal = win[maybe], first[maybe], row[maybe], words[maybe], literal[maybe]
                values = [[] if x else _slots(data, k, s, e, types) for k, x in zip(first.tolist(), literal.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + lo)), pa.array(win.view(np.int64)), pa.array(words.astype(np.int32)), pa.array(literal), pa.array(first - begin[row], pa.int64()), pa.array(values, pa.list_(pa.string()))], ["key", "win", "words", "literal", "place", "slots"])

    return rows.mapInArrow(run, f"key {kind}, win long, words int, literal boolean, place long, slots array<string>").distinct()


def _slot_counts(asked: list, slots: list) -> tuple[float, bool]:
    """Share of the slot places that hold the commonest value for what the item has there, and whether all hold the item's own."""
    answers: dict[str, Counter] = {}
    for x, y in zip(asked, slots, strict=True):
        for a, b in zip(x, y, strict=True):
            answers.setdefault(a, Counter())[b] += 1
    total = sum(sum(c.values()) for c in answers.values())
    right = sum(max(c.values()) for c in answers.values())
    return (right / total if total else 1.0), all(set(c) == {a} for a, c in answers.items())


def best_occurrence(place: np.ndarray, item_place: np.ndarray, win: np.ndarray, asked: list, slots: list, n: int, least: float) -> tuple[float, bool]:
    """(consistency, exact) of the best occurrence of an item of n different windows among its matches in one document.

    An occurrence lies around one offset of document to item: each window of the item takes the match of the nearest
    offset, at most the item's length away (for inserted or missing words). It counts if it covers the item. The whole
    document counts as one more, of all different matches.
    """
    different = {(w, tuple(a), tuple(b)) for w, a, b in zip(win.tolist(), asked, slots, strict=True)}
    best = _slot_counts([x[1] for x in different], [x[2] for x in different])
    offset = place - item_place
    order = np.lexsort((item_place, offset))
    offset, item_place, win = offset[order], item_place[order], win[order]
    span = int(item_place.max()) - int(item_place.min()) + WORDS
    for o in np.unique(offset).tolist():
        if best == (1.0, True):
            break
        lo, hi = np.searchsorted(offset, [o - span, o + span + 1])
        near = np.argsort(np.abs(offset[lo:hi] - o), kind="stable") + lo
        _, first = np.unique(item_place[near], return_index=True)
        at = near[first]
        if len(np.unique(win[at])) >= least * n:
            at = order[at].tolist()
            best = max(best, _slot_counts([asked[k] for k in at], [slots[k] for k in at]))
    return best


def _judged(pairs: DataFrame, least: float) -> DataFrame:
    """(key, item, literal, consistency, exact) of pairs (key, item, literal, n, win, place, item_place, asked, slots)."""
    kind = {f.name: f.dataType for f in pairs.schema.fields}
    rows = pairs.groupBy("key", "item", "literal", "n").agg(F.collect_list(F.struct("win", "place", "item_place", "asked", "slots")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, matches in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                win, place, item_place = (np.array([m[k] for m in matches], np.int64) for k in ("win", "place", "item_place"))
                out.append(best_occurrence(place, item_place, win, [m["asked"] for m in matches], [m["slots"] for m in matches], n, least))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.bool_())], ["key", "item", "literal", "consistency", "exact"])

    return rows.mapInArrow(run, f"key {kind['key'].simpleString()}, item {kind['item'].simpleString()}, literal boolean, consistency double, exact boolean")


def _bitmap(windows_: DataFrame, size: int) -> np.ndarray:
    """A bitmap over window hashes, of 16 bits for each but MOST_BITS at most."""
    bits = min(MOST_BITS, 1 << max(16, int(16 * size).bit_length()))
    slot = F.col("win").bitwiseAND(bits - 1)
    got = windows_.select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, cast(win & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def contained(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, coverage, consistency, exact) of every item that a document contains.

    exact tells that all slots have the item's own values. Null texts are empty; a text without words neither contains
    nor is contained; repeated rows (same id and text) count once; an item whose id repeats is the union of its texts;
    items equal as templates are all reported; empty tables give an empty result; extra columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    items = benchmark.select(F.col(item_id).alias("key"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).filter("key is not null")
    asked = materialize(_window_rows(items, None), "items")
    different = asked.select("win").distinct()
    size, short = different.count(), tuple(sorted(r.words for r in asked.select("words").distinct().collect() if r.words < WORDS))
    wanted = bits = None
    if size <= BROADCAST_WINDOWS:
        wanted = np.sort(different.toPandas()["win"].to_numpy(np.int64).view(np.uint64))
    else:
        bits = _bitmap(different, size)
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("rkey")).alias("key"), text.alias("text"))
    found = materialize(_window_rows(rows, wanted, bits, short), "windows")
    asked = asked.select(F.col("key").alias("item"), "win", "literal", F.col("place").alias("item_place"), F.col("slots").alias("asked"))
    each = asked.select("item", "literal", "win").distinct()
    each = each.join(each.groupBy("win").agg(F.count("*").alias("df")), "win")
    by = Window.partitionBy("item", "literal")
    each = each.withColumn("n", F.count("*").over(by)).withColumn("at", F.row_number().over(by.orderBy("df", "win")))
    each = materialize(each.select("item", "literal", "win", "n", (F.col("at") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).alias("probe")), "asked")
    seen = found.select("key", "win").distinct()
    near = seen.join(each.filter("probe").select("item", "literal", "n", "win"), "win").select("key", "item", "literal", "n").distinct()
    covered = near.join(seen, "key").join(each.select("item", "literal", "win"), ["item", "literal", "win"])
    covered = covered.groupBy("key", "item", "literal", "n").agg(F.count("*").alias("met")).filter(F.col("met") >= F.col("n") * least - 1e-9)
    covered = materialize(covered.select("key", "item", "literal", "n", (F.col("met") / F.col("n")).alias("coverage")), "covered")
    # Only of items that a document covers do the matches meet with their places.
    pairs = found.drop("literal").join(covered.select("key", "item", "literal", "n"), "key").join(asked, ["item", "literal", "win"])
    slots = _judged(pairs.select("key", "item", "literal", "n", "win", "place", "item_place", "asked", "slots"), least)
    out = covered.join(slots, ["key", "item", "literal"]).filter(F.col("consistency") >= least)
    out = out.groupBy("key", "item").agg(F.max(F.struct("coverage", "exact", "consistency")).alias("best"))
    return out.select("key.doc_id", F.col("key.rkey").alias("rkey"), F.col("item").alias("item_id"), "best.coverage", "best.consistency", "best.exact")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that contain no benchmark item.

    Null and empty texts stay; repeated rows stay or go together, by id and text; without items all rows stay; an empty
    table stays empty. Columns of any name pass through.
    """
    hit = contained(docs, benchmark, id_col, text_col).select(F.col("rkey").alias("__rkey")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("__rkey"))
    return rows.join(hit, "__rkey", "left_anti").select("__row.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("rkey")
