"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is cut into eight ring segments. If two fingerprints differ in at most three bits, the strong
pigeonring principle gives a start i whose chains of 1, 2, .. segments stay within the proportional budgets
3/8, 6/8, 9/8, .. of a bit: segments i and i+1 agree (below one bit), and segments i .. i+4 differ in at most one bit
(15/8). That one bit lies in the first or in the second half of segments i+2 .. i+4, so the other twelve bits agree
too. Each fingerprint is therefore filed under 16 exact keys of 28 bits, two for each start; candidates meet in a key,
pass the chain test and then the full Hamming check. Only a spanning set of links leaves a group, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, id_text, load, materialize, pack_rows, text_buffers

MAX_BITS = 3
BLOCK = 4096  # most fingerprints compared within one group; larger groups are split into pairs of blocks


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the word shingles of UTF-8 text; no words: 0; fewer words than a shingle: the whole sequence."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    rows = id_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(1))
            out = [fingerprint(data[s:e].tobytes(), words) for s, e in zip(at[:-1], at[1:], strict=True)]
            fps = pa.array(np.array(out, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def ring_keys(fps: np.ndarray) -> np.ndarray:
    """The 16 keys of each fingerprint, [n, 16]: start, half and 28 bits."""
    out = np.empty((len(fps), 16), np.int64)
    for start in range(8):
        turn = np.uint64(8 * start)
        ring = (fps >> turn) | (fps << ((np.uint64(64) - turn) % np.uint64(64)) if start else np.uint64(0))
        exact = ring & np.uint64(0xFFFF)
        for half in range(2):
            rest = (ring >> np.uint64(16 + 12 * half)) & np.uint64(0xFFF)
            out[:, 2 * start + half] = (exact | rest << np.uint64(16) | np.uint64((2 * start + half) << 28)).astype(np.int64)
    return out


def chain_ok(diff: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The pigeonring test from a start: the first l segments differ in at most l * 3 / 8 bits, for l = 1 .. 8."""
    turn = (np.uint64(8) * start.astype(np.uint64)) % np.uint64(64)
    ring = np.where(turn == 0, diff, (diff >> turn) | (diff << ((np.uint64(64) - turn) % np.uint64(64))))
    ok = np.ones(len(diff), bool)
    for seg in range(1, 9):
        mask = np.uint64((1 << (8 * seg)) - 1)
        ok &= np.bitwise_count(ring & mask) * 8 <= seg * MAX_BITS
    return ok


def link_groups(group: np.ndarray, start: np.ndarray, fps: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fp, fp) of the true pairs in consecutive equal groups; side: only rows of different sides are compared."""
    n = len(fps)
    first = np.r_[True, group[1:] != group[:-1]]
    ends = np.r_[np.flatnonzero(first)[1:], n]
    last = np.repeat(ends, np.diff(np.r_[np.flatnonzero(first), n]))
    label = np.arange(n)
    at, shift = np.arange(n), 1
    while True:
        at = at[at + shift < last[at]]
        if not len(at):
            break
        other = at + shift
        open_ = label[at] != label[other]
        if side is not None:
            open_ &= side[at] != side[other]
        i, j = at[open_], other[open_]
        diff = fps[i] ^ fps[j]
        good = np.bitwise_count(diff) <= MAX_BITS
        i, j, diff = i[good], j[good], diff[good]
        good = chain_ok(diff, start[i])
        i, j = i[good], j[good]
        while len(i):
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            while not np.array_equal(nxt := label[label], label):
                label = nxt
            rest = label[i] != label[j]
            i, j = i[rest], j[rest]
        shift += 1
    linked = np.flatnonzero(label != np.arange(n))
    return fps[linked], fps[label[linked]]


def _links_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Reads rows in group order, so that a group is whole once the next one begins.

    Keys (key, lo, hi): a pair of blocks, each row of the block `mine`; rows of one block meet in (key, block, block) alone.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    kept: list[pa.Table] = []

    def flush(table: pa.Table) -> pa.RecordBatch:
        cols = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(table.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        fps = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        side = np.where(cols[1] == cols[2], np.arange(table.num_rows), table.column("mine").to_numpy()) if len(cols) > 1 else None
        a, b = link_groups(np.cumsum(change), cols[0] >> 29, fps, side)
        return pack_rows(schema, a.view(np.int64), b.view(np.int64))

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(pa.Table.from_batches([batch]))
        table = pa.concat_tables(kept)
        if table.num_rows < 20_000:
            continue
        same = np.ones(table.num_rows, bool)
        for k in keys:
            c = table.column(k).to_numpy()
            same &= c == c[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield flush(table.slice(0, cut))
        kept = [table.slice(cut)]
    if kept:
        yield flush(pa.concat_tables(kept))


def near_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between different fingerprints of column fp, enough to join all that is reachable."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ring_keys(x.view(np.uint64)).ravel()), pa.array(np.repeat(x, 16))], ["key", "fp"])

    keyed = fps.select("fp").mapInArrow(keys, "key long, fp long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    sized = materialize(keyed.join(sizes, "key"), "ring")
    small = sized.filter(F.col("n") <= block).select("key", "fp").repartition("key").sortWithinPartitions("key")
    small = small.mapInArrow(lambda it: _links_of(it, ["key"]), "a long, b long")
    # A group over the block size: blocks by a hash of the fingerprint, each pair of blocks a group of its own.
    big = sized.filter(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") * 2 / block))
    big = big.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    big = big.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    big = big.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp", "mine")
    big = big.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    big = big.mapInArrow(lambda it: _links_of(it, ["key", "lo", "hi"]), "a long, b long")
    return small.union(big)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links of at most three bits).

    A null or blank text has fingerprint zero and links like any other. Repeated rows are kept; an empty table gives
    an empty result; a null id has a component but is never its smallest id unless all its ids are null.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words), "fp")
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "reps")
    roots = components(near_links(reps, block))
    placed = reps.join(roots, reps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """docs, with its columns, with one row of each group of near-duplicates: that of the smallest id.

    Shingles have five words here. Null ids come last; of rows equal in id and text one stays; null and blank texts are
    near-duplicates of each other; an empty table stays empty. Columns of any name pass through.
    """
    rkey = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), rkey.alias("rkey"))
    groups = near_duplicates(docs.select(order.alias("__order"), F.col(text_col).alias("__text")), "__order", "__text", words)
    kept = materialize(groups.filter("doc_id = component_id").groupBy(F.col("doc_id.rkey").alias("__rkey")).agg(F.count("*").alias("n")), "kept")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), rkey.alias("__rkey")).join(kept.select("__rkey"), "__rkey", "left_semi")
    if not kept.filter("n > 1").isEmpty():
        rows = rows.dropDuplicates(["__rkey"])
    return rows.select("__row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
