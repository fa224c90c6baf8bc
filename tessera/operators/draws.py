"""Draws by md5, many at a time: the numbers of evaluate.hashed(seed, repeat, draw), without a row for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AT_ONCE, REPEATS = 8192, 50  # draws and repeats of a unit of work
MOST_VALUES = 1 << 22  # values that a broadcast holds

_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]


def md5_head(prefix: bytes, digits: np.ndarray) -> np.ndarray:
    """The first 60 bits of the md5 of prefix and each column of digits (character codes, uint32); 55 characters at most."""
    size = len(prefix) + len(digits)
    message = [*prefix, *digits, 0x80, *[0] * (55 - size), *(8 * size).to_bytes(8, "little")]
    words = []
    for w in range(16):
        fixed, own = 0, None
        for k, x in enumerate(message[4 * w : 4 * w + 4]):
            if isinstance(x, np.ndarray):
                x = x << np.uint32(8 * k)
                own = x if own is None else own | x
            else:
                fixed |= x << 8 * k
        words.append((fixed, own))
    start = [np.full(digits.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start
    for i in range(64):
        turn = i // 16
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        fixed, own = words[g]
        f += a
        f += np.uint32((_SINES[i] + fixed) & 0xFFFFFFFF)
        if own is not None:
            f += own
        s = _SHIFTS[turn][i % 4]
        t = f << np.uint32(s)
        f >>= np.uint32(32 - s)
        t |= f
        t += b
        a, d, c, b = d, c, b, t
    high, low = ((x + y).byteswap().astype(np.uint64) for x, y in zip((a, b), start, strict=False))
    return (high << np.uint64(32) | low) >> np.uint64(4)


def runs_of_digits(lo: int, hi: int) -> Iterator[np.ndarray]:
    """The decimal digits of lo .. hi - 1 as character codes, [digits, numbers], by runs of as many digits."""
    while lo < hi:
        size = len(str(lo))
        end = min(hi, 10**size)
        x = np.arange(lo, end)
        yield np.stack([x // 10**k % 10 + 48 for k in reversed(range(size))]).astype(np.uint32)
        lo = end


def _units(ids: Iterator[pa.RecordBatch], n: int, repeats: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(repeat, places from 0 of its draws) of each unit of work."""
    groups = -(-repeats // REPEATS)
    for batch in ids:
        for unit in batch.column(0).to_pylist():
            lo = unit // groups * AT_ONCE
            runs = list(runs_of_digits(lo, min(n, lo + AT_ONCE)))
            first = unit % groups * REPEATS
            for rep in range(first, min(repeats, first + REPEATS)):
                head = f"{seed}|{rep}|".encode()
                yield rep, np.concatenate([md5_head(head, x) for x in runs]) % np.uint64(n)


def resampled_means(rows: DataFrame, n: int, repeats: int, seed: int, most: int = MOST_VALUES) -> DataFrame:
    """(rep, m): the mean of v, nulls apart, over the n draws of each repeat; rows: (at, v), at from 0 to n - 1.

    Up to `most` values go to all executors; more are joined with the places drawn.
    """
    spark = rows.sparkSession
    units = -(-n // AT_ONCE) * -(-repeats // REPEATS)
    parts = max(1, min(units, max(4 * spark.sparkContext.defaultParallelism, units // 64)))
    ids = spark.range(0, units, 1, parts)
    if n > most:

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rep, at in _units(batches, n, repeats, seed):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), rep)), pa.array(at.view(np.int64))], ["rep", "at"])

        return ids.mapInArrow(places, "rep long, at long").join(rows, "at").groupBy("rep").agg(F.avg("v").alias("m"))
    got = rows.select("at", "v").toArrow()
    place, v = got.column("at").to_numpy(), got.column("v")
    values, known = np.zeros(n), np.zeros(n, bool)
    known[place] = v.is_valid().to_numpy()
    values[place] = v.fill_null(0.0).to_numpy()
    shared = spark.sparkContext.broadcast((values.tobytes(), known.tobytes()))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, known = (np.frombuffer(x, t) for x, t in zip(shared.value, (np.float64, bool), strict=True))
        out = [(rep, float(values[at].sum()), int(known[at].sum())) for rep, at in _units(batches, n, repeats, seed)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.int64()))], ["rep", "total", "n"])

    summed = ids.mapInArrow(sums, "rep long, total double, n long").groupBy("rep").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return summed.select("rep", (F.col("total") / F.nullif("n", F.lit(0))).alias("m"))
