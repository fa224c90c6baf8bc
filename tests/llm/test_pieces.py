import math

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary.load(PATH)


TEXTS = [
    None, "", " ", "Hello  world\n  foo", " a", "a b c　d", "ﬁ①Ａ漢字 🙂", "<0x0A> <s> ▁a", "\t\r\na\n\n b ", "x" * 700, "the the the theatre", "été déjà  vu   fini    quatre",
    "w" + " " * 37 + "z", "no break", "á",
]


def test_encoding_equals_the_library(spark, vocabulary):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(1000, "twice"), (None, "twice")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, chunk int")
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = sorted((repr(d), lib.encode(t or "")) for d, t in rows)
    got = P.round_trip(df, vocabulary, hot=300, known=1000).collect()
    assert sorted((repr(r.doc_id), list(r.ids)) for r in got) == want
    assert all(r.restored and r.n_tokens == len(r.ids) for r in got if r.doc_id != 1007)


def test_decoding_equals_the_library(spark, vocabulary):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = [[28705], [3 + 0xC3, 3 + 0xA9, 264], [1, 28705, 264, 2], [], [22557, 28705, 1526]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)] + [(9, None)], "k int, ids array<int>")
    got = {r.k: r.decoded for r in P.decode(df, vocabulary).collect()}
    assert [got[i] for i in range(len(ids))] == [lib.decode(x) for x in ids] and got[9] is None


def best_path(text, scores, unknown):
    best = [(0.0, [0])] + [None] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(e):
            piece = text[s:e]
            cost = scores.get(piece, unknown if len(piece) == 1 else None)
            if cost is not None and (best[e] is None or best[s][0] + cost > best[e][0]):
                best[e] = (best[s][0] + cost, best[s][1] + [e])
    return best[-1]


def test_viterbi_fold_for_unigram_models(spark):
    words = {"▁th": -2.5, "e": -3.1, "▁": -2.2, "t": -4.0, "h": -4.1, "he": -2.9, "▁the": -3.3, "n": -3.7, "▁then": -8.0, "ab": -5.25, "a": -3.5, "b": -3.6, "aba": -6.7}
    pieces = [(p, i + 3, s) for i, (p, s) in enumerate(words.items())]
    v = P.Vocabulary(pieces, [], 0, 99, False, [])
    units = [" the", " then", "abab", " thx", "ababa", "q", "heth"]
    got = {r.unit: r.ids for r in P.encoded_units(spark.createDataFrame([(u,) for u in units * 2], "unit string"), v).collect()}
    import numpy as np

    arrow = P.Lattice(v).encode([u.encode() for u in units], np.dtype("<i4"))
    assert {u: np.frombuffer(x, "<i4").tolist() for u, x in zip(units, arrow)} == {u: list(x) for u, x in got.items()}
    score = {i: s for _, i, s in pieces}
    for u in units:
        total, _ = best_path(u.replace(" ", P.SPACE), words, min(words.values()) - 10)
        assert math.isclose(sum(score.get(i, min(words.values()) - 10) for i in got[u]), total), u


def test_the_two_forms_of_the_merge_fold_agree(spark, vocabulary):
    import numpy as np

    units = [" the", "Spark", " internationalization", " ", "    x", " éà漢", "ééé", "a" * 35, ".com();", "\n", " " * 9]
    df = spark.createDataFrame([(u,) for u in units], "unit string")
    a = {r.unit: list(r.ids) for r in P.encoded_units(df, vocabulary).collect()}
    b = P.Lattice(vocabulary).encode([u.encode() for u in units], np.dtype("<u2"))
    assert a == {u: np.frombuffer(x, "<u2").tolist() for u, x in zip(units, b)}


@pytest.mark.parametrize("kind", ["chinese", "letters", "digits", "one letter", "words"])
def test_a_million_bytes_without_a_line(vocabulary, kind):
    import base64
    import random
    import time

    import numpy as np

    rng = random.Random(1)
    text = {
        "chinese": lambda: "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(330_000)), "letters": lambda: base64.b64encode(rng.randbytes(750_000)).decode(),
        "digits": lambda: "".join(rng.choices("0123456789", k=1_000_000)), "one letter": lambda: "x" * 300_000, "words": lambda: "internationalization" * 30_000,
    }[kind]()
    began = time.time()
    ids = np.frombuffer(P.Lattice(vocabulary).encode([(" " + text).encode()], np.dtype("<u2"))[0], "<u2").tolist()
    assert time.time() - began < 30
    assert ids == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text)


def test_a_row_of_a_megabyte_and_odd_ids(spark, vocabulary):
    text = "日本語テキスト" * 60_000
    df = spark.createDataFrame([([1, 2], text), ([1, 2], text), (None, None)], "who array<int>, text string").withColumn("doc_id", F.lit("clash"))
    got = P.round_trip(df, vocabulary, "who").collect()
    want = sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text)
    assert sorted(r.n_tokens for r in got) == [0, len(want), len(want)] and all(r.restored for r in got)
    assert all(list(r.ids) == want for r in got if r.doc_id)


def test_empty_table(spark, vocabulary):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.round_trip(df, vocabulary).count() == 0
