"""Similarities of token arrays and of strings.

Set similarities are array functions. Longest common subsequences have no built-in form and are computed bit-parallel
in Arrow batches, all pairs of a batch side by side where the short side fits a word; everything around them (sorting, sets, lengths, maxima) stays in the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct elements; two empty sets are equal."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def ngrams(s: Column, n: int) -> Column:
    short = F.array().cast("array<string>")
    return F.when(F.length(s) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substr(s, i, F.lit(n))))).otherwise(short)


def ngram_jaccard(a: Column, b: Column, n: int) -> Column:
    """Both empty: 1; one shorter than n: 0."""
    return F.when((F.length(a) == 0) & (F.length(b) == 0), F.lit(1.0)).when((F.length(a) < n) | (F.length(b) < n), F.lit(0.0)).otherwise(jaccard(ngrams(a, n), ngrams(b, n)))


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct elements of a that b has; none: 0."""
    n = F.size(F.array_distinct(a))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine step for each character of the longer string."""
    if not a or not b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for ch in b:
        if hit := open_ & where.get(ch, 0):
            open_ = (open_ + hit) | (open_ - hit)
    return len(a) - (open_ & full).bit_count()


def indel_ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * lcs_length(a, b) / n


def best_window_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer of its length, cut short at the ends."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    best = 0.0
    for short, long_ in ((a, b), (b, a)) if len(a) == len(b) else ((min(a, b, key=len), max(a, b, key=len)),):
        n, known = len(short), set(short)
        for end in range(1, len(long_) + n):
            window = long_[max(0, end - n) : end]
            # A window that ends (or, past the end, begins) with a foreign letter has a neighbour as good.
            if (window[-1] if end <= len(long_) else window[0]) not in known or 200.0 * min(n, len(window)) / (n + len(window)) <= best:
                continue
            best = max(best, indel_ratio(short, window))
            if best == 100.0:
                return best
    return best


#: The longest short side whose table row is one word of bits, the longest long side, and places of a slice of pairs.
WORD, LONGEST, CELLS = 64, 512, 1 << 20


def _padded(texts: list[str], letters, sizes):  # noqa: ANN001, ANN202
    """A column of letter numbers for each text, filled up with the number of no letter."""
    import numpy as np

    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    number = np.zeros(int(letters[-1]) + 1, np.int32)
    number[letters] = np.arange(len(letters))
    out = np.full((int(sizes.max(initial=0)), len(texts)), len(letters), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at, np.repeat(np.arange(len(texts)), sizes)] = number[flat]
    return out


def _masks(short, n, long_, letters: int, backward: bool = False):  # noqa: ANN001, ANN202
    """For each letter of the long sides, the places of the short side (WORD at most; backward: from its end) that hold it."""
    import numpy as np

    base = np.arange(len(n)) * (letters + 1)
    where = np.zeros(len(n) * (letters + 1), np.uint64)
    for i in range(len(short)):
        at = base + short[i]
        where[at] |= np.uint64(1) << (n - 1 - i if backward else np.full(len(n), i)).astype(np.uint64) % np.uint64(WORD)
    where[base + letters] = 0
    return where[base + long_]


def _unmatched(n):  # noqa: ANN001, ANN202
    """All places of short sides of these sizes."""
    import numpy as np

    return np.where(n >= WORD, ~np.uint64(0), (np.uint64(1) << (n % WORD).astype(np.uint64)) - np.uint64(1))


def _in_words(pairs: list[tuple[str, str]], score, alone):  # noqa: ANN001, ANN202
    """score(short, sizes, long, sizes, letters) of pairs whose sides fit, a slice at a time; alone(a, b) of the others."""
    import numpy as np

    out = np.zeros(len(pairs))
    sides = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    fit = []
    for k, (a, b) in enumerate(sides):
        if a and len(a) <= WORD and len(b) <= LONGEST:
            fit.append(k)
        else:
            out[k] = alone(*pairs[k])
    fit.sort(key=lambda k: len(sides[k][1]))  # like lengths beside each other need little filling up
    lo = 0
    while lo < len(fit):
        # The longest of a slice is its last: take rows while the filled table stays small.
        hi = min(len(fit), lo + 4096)
        while hi > lo + 1 and (hi - lo) * (len(sides[fit[hi - 1]][1]) + WORD) > CELLS:
            hi = lo + (hi - lo) // 2
        short, long_ = [sides[k][0] for k in fit[lo:hi]], [sides[k][1] for k in fit[lo:hi]]
        letters = np.unique(np.frombuffer("".join(short + long_).encode("utf-32-le", "surrogatepass"), np.uint32))
        n, m = (np.array(list(map(len, x)), np.int64) for x in (short, long_))
        out[fit[lo:hi]] = score(_padded(short, letters, n), n, _padded(long_, letters, m), m, len(letters))
        lo = hi
    return out


def _lcs_score(short, n, long_, m, letters: int):  # noqa: ANN001, ANN202, ARG001
    """lcs_length of many pairs side by side."""
    import numpy as np

    open_ = np.full(len(n), ~np.uint64(0))
    for places in _masks(short, n, long_, letters):
        hit = open_ & places
        open_ = (open_ + hit) | (open_ - hit)
    return n - np.bitwise_count(open_ & _unmatched(n)).astype(np.int64)


def _window_score(short, n, long_, m, letters: int):  # noqa: ANN001, ANN202
    """best_window_ratio of many pairs side by side: the windows of one end at a time, read backward from it."""
    import numpy as np

    best = np.zeros(len(n))
    for a, na, b, nb, rows in ((short, n, long_, m, np.arange(len(n))), (long_, m, short, n, np.flatnonzero(n == m))):
        if not len(rows):
            continue
        na, nb = na[rows], nb[rows]
        places = _masks(a[: int(na.max()), rows], na, b[:, rows], letters, True)
        all_ = _unmatched(na)
        inside = [np.where(na > i, ~np.uint64(0), np.uint64(0)) for i in range(int(na.max()))]
        top = best[rows]
        for end in range(1, int((nb + na).max())):
            open_ = np.full(len(rows), ~np.uint64(0))
            for i in range(max(0, end - len(places)), min(end, len(inside))):
                hit = open_ & places[end - 1 - i] & inside[i]
                open_ = (open_ + hit) | (open_ - hit)
            common = na - np.bitwise_count(open_ & all_).astype(np.int64)
            size = np.minimum(end, nb) - np.maximum(end - na, 0)
            top = np.maximum(top, np.where(end < nb + na, 200.0 * common / np.maximum(na + size, 1), 0.0))
        best[rows] = top
    return best


def lcs_lengths(pairs: list[tuple[str, str]]):  # noqa: ANN201
    return _in_words(pairs, _lcs_score, lcs_length)


def best_window_ratios(pairs: list[tuple[str, str]]):  # noqa: ANN201
    return _in_words(pairs, _window_score, best_window_ratio)


def _of_batch(a, b, many):  # noqa: ANN001, ANN202
    """many() of the different pairs of a batch, given to each of its rows."""
    import numpy as np

    place: dict[tuple[str, str], int] = {}
    at = [place.setdefault((x or "", y or ""), len(place)) for x, y in zip(a, b, strict=True)]
    return many(list(place))[np.array(at, np.int64)]


@F.pandas_udf(IntegerType())
def lcs(a, b):  # noqa: ANN001, ANN201
    import pandas as pd

    return pd.Series(_of_batch(a, b, lcs_lengths).astype("int32"))


@F.pandas_udf(DoubleType())
def partial_ratio(a, b):  # noqa: ANN001, ANN201
    import pandas as pd

    return pd.Series(_of_batch(a, b, best_window_ratios))


#: White space as (?U)\\s+ has it.
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class _Known(dict):
    """What a function gives for each different text."""

    def __init__(self, of) -> None:  # noqa: ANN001
        self.of = of

    def __missing__(self, text: str):  # noqa: ANN204
        out = self[text] = self.of(text)
        return out


def _words(s: str) -> list[str]:
    return sorted({w for w in SPACES.split(s) if w})


def set_ratios(pairs: list[tuple[str, str]]):  # noqa: ANN201
    """token_set_ratio of each pair: words split once for each text, rests side by side."""
    import numpy as np

    known, rests, sizes = _Known(_words), [], np.zeros((4, len(pairs)))
    for k, (a, b) in enumerate(pairs):
        x, y = known[a], known[b]
        ra, rb = " ".join(w for w in x if w not in y), " ".join(w for w in y if w not in x)
        rests.append((ra, rb))
        sizes[:, k] = len(" ".join(w for w in x if w in y)), len(ra), len(rb), bool(x) and bool(y)
    sh, la, lb, full = sizes
    gap = (sh > 0).astype(float)
    best = 200.0 * (sh + gap + lcs_lengths(rests)) / np.maximum(2 * (sh + gap) + la + lb, 1)
    ends = np.maximum(200.0 * sh / np.maximum(2 * sh + gap + la, 1), 200.0 * sh / np.maximum(2 * sh + gap + lb, 1))
    best = np.where(gap > 0, np.where((la == 0) | (lb == 0), 100.0, np.maximum(best, ends)), best)
    return np.where(full > 0, best, 0.0)


def sort_ratios(pairs: list[tuple[str, str]]):  # noqa: ANN201
    """token_sort_ratio of each pair."""
    import numpy as np

    known = _Known(lambda s: " ".join(sorted(w for w in SPACES.split(s) if w)))
    pairs = [(known[a], known[b]) for a, b in pairs]
    total = np.array([len(a) + len(b) for a, b in pairs], float)
    return np.where(total > 0, 200.0 * lcs_lengths(pairs) / np.maximum(total, 1), 100.0)


def gram_jaccards(pairs: list[tuple[str, str]], n: int):  # noqa: ANN201
    """ngram_jaccard of each pair, the n-grams cut once for each text."""
    import numpy as np

    known = _Known(lambda s: {s[i : i + n] for i in range(len(s) - n + 1)})
    out = np.zeros(len(pairs))
    for k, (a, b) in enumerate(pairs):
        x, y = known[a], known[b]
        both = len(x & y)
        out[k] = 1.0 if not a and not b else both / (len(x) + len(y) - both) if x and y else 0.0
    return out


@F.pandas_udf(DoubleType())
def set_ratio(a, b):  # noqa: ANN001, ANN201
    import pandas as pd

    return pd.Series(_of_batch(a, b, set_ratios))


@F.pandas_udf(DoubleType())
def sort_ratio(a, b):  # noqa: ANN001, ANN201
    import pandas as pd

    return pd.Series(_of_batch(a, b, sort_ratios))


def gram_jaccard(a: Column, b: Column, n: int) -> Column:
    @F.pandas_udf(DoubleType())
    def grams(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(_of_batch(a, b, lambda pairs: gram_jaccards(pairs, n)))

    return grams(a, b)


def _of_lengths(common: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * common / total)


def ratio(a: Column, b: Column) -> Column:
    """100 * 2 LCS / (length + length); two empty strings: 100."""
    return _of_lengths(lcs(a, b), F.length(a) + F.length(b))


def split_words(s: Column) -> Column:
    return F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")


def sorted_words(s: Column) -> Column:
    return F.array_join(F.array_sort(split_words(s)), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(sorted_words(a), sorted_words(b))


def token_set_parts(a: Column, b: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Sets of tokens of both; the joined sorted rest of each, and the length of what they share."""
    x, y = F.array_distinct(split_words(a)), F.array_distinct(split_words(b))
    shared = F.array_intersect(x, y)
    rest = lambda s, t: F.array_join(F.array_sort(F.array_except(s, t)), " ")
    return x, y, rest(x, y), rest(y, x), F.length(F.array_join(shared, " "))


def token_set_ratio(a: Column, b: Column) -> Column:
    """An empty side: 0; a shared token and one set within the other: 100; else the best of rests and lengths."""
    x, y, rest_a, rest_b, shared = token_set_parts(a, b)
    gap = F.when(shared > 0, F.lit(1)).otherwise(F.lit(0))
    len_a, len_b = F.length(rest_a), F.length(rest_b)
    with_a, with_b = shared + gap + len_a, shared + gap + len_b
    whole = _of_lengths(shared + gap + lcs(rest_a, rest_b), with_a + with_b)
    ends = F.greatest(_of_lengths(shared, shared + with_a), _of_lengths(shared, shared + with_b))
    contained = (shared > 0) & ((len_a == 0) | (len_b == 0))
    return (
        F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).when(contained, F.lit(100.0)).when(shared > 0, F.greatest(whole, ends)).otherwise(whole)
    )


def contains_either(a: Column, b: Column) -> Column:
    """One non-empty string within the other."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a))


def boosted(score: Column, a: Column, b: Column, least: float) -> Column:
    return F.when(contains_either(a, b), F.greatest(score, F.lit(least))).otherwise(score)
