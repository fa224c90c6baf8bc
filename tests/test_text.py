"""Scalar functions against known values and plain Python statements of the same rules."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.functions import text as T


def value(spark, expr, *args):
    names = [f"c{i}" for i in range(len(args))]
    df = spark.createDataFrame([args], ", ".join(f"{n} string" for n in names))
    return df.select(expr(*map(F.col, names)).alias("v")).first().v


@pytest.mark.parametrize(
    "function, given, want",
    [
        (T.normalize_name, "Pvt. EFS Print Ventures Ltd.", "private efs print ventures limited"),
        (T.normalize_name, "Smith & Sons Mfg", "smith and sons manufacturing"),
        (T.normalize_name, None, ""),
        (T.normalize_address, "797, Lake Town, Kolkata 700089", "797 lake town kolkata 700089"),
        (T.normalize_address, "12 N Main St", "12 north main street"),
        (T.transliterate, "कमल", "kml"),
        (T.transliterate, "a२।b", "ab"),
        (T.transliterate, "কা", "kaa"),
        (T.clean, "Café ÄB", "cafe ab"),
        (T.clean, None, ""),
        (T.phonetic, "Prvt Blu prvtx pshchimbngg", "private blue prvtx west bengal"),
        (T.compact_key, "certifiedeliterain.com", "certifiedeliterain"),
        (T.compact_key, "Telecom", "tele"),
        (T.pure_name, "A-B  cé", "a b c"),
        (T.simple_clean, " éa-B\t", "a b"),
    ],
)
def test_strings(spark, function, given, want):
    assert value(spark, function, given) == want


@pytest.mark.parametrize(
    "function, given, want",
    [
        (T.index_tokens, "Visit https://x.com/abc www.foo.net Acme-Widgets.com the road ab", {"visit", "acme", "widgets"}),
        (T.number_street_keys, "1525 Peoria Road 7 Aurora", {"1525_peoria", "1525_aurora"}),
        (T.number_street_keys, "7 Oak, 007 Elm", {"7_oak", "7_elm"}),
        (T.number_street_keys, "Oak Lane", set()),
        (T.channel_name_tokens, "Blu Bolt pvt ltd Bolt", {"blue", "bolt"}),
        (T.numeric_tokens, "12 345 6789", {"345", "6789"}),
        (T.id_list, " a, ,b,", {"a", "b"}),
        (T.id_list, None, set()),
        (T.name_tokens, "The Co of X Ab", {"company", "ab"}),
    ],
)
def test_token_sets(spark, function, given, want):
    got = value(spark, function, given)
    assert set(got) == want and len(got) == len(set(got))


GOLD = [
    ("certified elite rain gutters co. 1525 peoria st, aurora, co 80010", "certified elite gutters llc 1525 peoria street, aurora, colorado", 80.620155, 82.170543),
    ("small ring 11 economy", "red widget 17 economy", 61.904762, 61.904762), ("blue bolt", "bolt blue", 55.555556, 100.0),
    ("raj investments llp", "raj investments corp", 87.179487, 88.235294), ("abc", "abd", 66.666667, 66.666667), ("", "abc", 0.0, 0.0),
]


def test_known_ratios(spark):
    df = spark.createDataFrame([(a, b) for a, b, _, _ in GOLD], "a string, b string")
    got = df.select(S.ratio(F.col("a"), F.col("b")).alias("r"), S.token_set_ratio(F.col("a"), F.col("b")).alias("t"), S.token_set_ratio(F.col("b"), F.col("a")).alias("u")).collect()
    for row, (_, _, r, t) in zip(got, GOLD, strict=True):
        assert abs(row.r - r) < 1e-6 and abs(row.t - t) < 1e-6 and abs(row.u - t) < 1e-6


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_subsequences_and_windows():
    import random

    rng = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert S.lcs_length(a, b) == plain_lcs(a, b)
        short, long_ = sorted((a, b), key=len)
        if short:
            # Of two strings of one length, each takes its turn as the shorter.
            pairs = [(short, long_), (long_, short)] if len(a) == len(b) else [(short, long_)]
            best = max(S.indel_ratio(x, y[max(0, e - len(x)) : e]) for x, y in pairs for e in range(1, len(y) + len(x)))
            assert abs(S.best_window_ratio(a, b) - best) < 1e-9
    assert S.best_window_ratio("", "") == 100.0 and S.best_window_ratio("", "a") == 0.0


def test_composition(spark):
    assert value(spark, lambda c: T.normalize_name(c, compose=True), "Cafe\u0301 Co") == "caf\u00e9 company"


def test_set_similarities_of_empty_sides(spark):
    e = F.array().cast("array<string>")
    row = spark.range(1).select(S.jaccard(e, e).alias("j"), S.overlap(e, F.array(F.lit("a"))).alias("o"), S.ngram_jaccard(F.lit(""), F.lit(""), 3).alias("n"), S.ngram_jaccard(F.lit("ab"), F.lit("abc"), 3).alias("m")).first()
    assert (row.j, row.o, row.n, row.m) == (1.0, 0.0, 1.0, 0.0)


def test_common_subsequences_side_by_side_equal_those_one_by_one():
    """All lengths around a word of bits, letters of all planes, empty and long sides."""
    import random

    from tessera.functions import similarity as S

    rng = random.Random(7)
    word = lambda n, letters="abcd é𝄞": "".join(rng.choice(letters) for _ in range(n))
    sizes = [0, 1, 2, 5, 13, 31, 62, 63, 64, 65, 80, 513, 600]
    pairs = [(word(rng.choice(sizes)), word(rng.choice(sizes))) for _ in range(60)] + [(word(rng.randrange(20)), word(rng.randrange(25))) for _ in range(300)]
    assert S.lcs_lengths(pairs).tolist() == [S.lcs_length(a, b) for a, b in pairs]
    small = [p for p in pairs if max(map(len, p)) < 90]
    got, want = S.best_window_ratios(small).tolist(), [S.best_window_ratio(a, b) for a, b in small]
    assert all(abs(x - y) < 1e-9 for x, y in zip(got, want, strict=True))
    assert not len(S.lcs_lengths([]))
