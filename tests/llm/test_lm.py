import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import lm as L


def test_seating_follows_the_restaurant_rule():
    rng = np.random.default_rng(0)
    n, c, base, discount, theta, others = 4000, 15, 0.2, 0.4, 1.0, 3

    def slow():
        t = 1
        for here in range(1, c):
            opens = (theta + discount * (others + t)) * base
            t += rng.random() < opens / (here - discount * t + opens)
        return t

    want = np.mean([slow() for _ in range(n)])
    got = L.seat(np.full(n, c), np.full(n, base), np.full(n, others), discount, theta, rng)
    assert abs(got.mean() - want) < 0.1 and got.min() >= 1 and got.max() <= c
    assert L.seat(np.array([1, 5_000_000, 2]), np.array([0.5, 1e-4, 0.1]), np.zeros(3), 0.5, 1.0, rng)[0] == 1


def letters(words):
    return np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])


def test_spelling_is_a_distribution():
    words = [b"the", b"then", b"a", L.END, "\u00e9t\u00e9".encode()]
    keys, counts = L.spelled_keys(*letters(words), np.array([9, 3, 5, 4, 1]))
    rng, s = np.random.default_rng(1), None
    for _ in range(4):
        s = L.Spelling.sample(keys, counts, np.array([5 * L.SYMBOLS + 7]), np.array([2]), s, rng)
    symbols = np.arange(257)
    for context in [*np.unique(keys // L.SYMBOLS), (3 * L.SYMBOLS + 5) * L.SYMBOLS + 7, 5]:
        assert np.isclose(s.predictive(context * L.SYMBOLS + symbols, 3).sum(), 1)
    said = s.log10(*letters([b"the", b"zqx", b"a", b"the", L.END]))
    assert said[0] > said[1] and said[0] == said[3] and said[4] < 0


def test_arrays_on_their_way():
    arrays = [np.zeros(0, np.int64), np.arange(1000) ** 2, np.array([1.5, -2], np.float32), np.array([True, False]), np.array([2**64 - 1], np.uint64)]
    for x, y in zip(arrays, L.get(L.put(*arrays)), strict=True):
        assert x.dtype == y.dtype and np.array_equal(x, y)
    lp = np.array([-0.0, -3.25, -31.9, -32.1, -5000.0])
    assert np.allclose(L._unlogs(*L._logs(lp)), lp, atol=3e-4)


def brute(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), L.END]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return n, [(i, held(i), len(w := tokens(t)), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, t in rows]


MORE = [(900, None), (901, ""), (902, "A b A\tzz\u00a0y"), (None, "only here"), (903, "x" * 5000)]
SMALL = {"chunk": 20_000, "word_bytes": 60_000, "pair_bytes": 40_000}


def test_contract_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + MORE
    df = spark.createDataFrame([(*r, 0.5, 1, "w") for r in rows], "doc_id long, text string, score double, chunk int, who string")
    got = {r.doc_id: r for r in L.scores(df, **SMALL).collect()}
    n, want = brute(rows)
    assert len(got) == len(want)
    for doc, held, tokens, known, base in want:
        r = got[doc]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0 and np.isfinite(r.score)


def test_scores_do_not_depend_on_the_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = []
    for n, partitions in ((3, "2"), (11, "7")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got.append(sorted(map(tuple, L.scores(docs.repartition(n), **SMALL).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_scores_equal_the_plain_predictive(spark):
    """Seats of the kept sweeps, written out as dictionaries, give the scores word by word."""
    rows = [(k, " ".join("abcde"[(k * j + j // 3) % 5] * (1 + j % 2) for j in range(40)) + " the end") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.col("doc_id") % 5 == 0).withColumn("who", F.struct("doc_id", "held_out"))
    model = L.fitted(df.select("who", "held_out", "text"), chunk=500, word_bytes=2000, pair_bytes=1000)
    answers = L.probabilities(model.state, model.asked, model.plan, model.discounts[1], model.often)
    got = {r.who.doc_id: r.score for r in L.summed(model.chunks, answers, model.plan, model.chunks.schema["who"].dataType.simpleString()).collect()}
    # Numbers of the words, from their buckets.
    number, word_tables = {}, {}
    for r in model.words.collect():
        count, size, data, tables = L.get(r.payload)
        at = 0
        for k, (n, t) in enumerate(zip(size.tolist(), tables.tolist())):
            word = data[at : at + n].tobytes()
            number[word], word_tables[word] = int(model.plan.offsets[r.bucket]) + k, t
            at += n
    d1, d2 = model.discounts
    sweeps = [{}, {}]
    for r in model.state.collect():
        step, count = L.get(r.pairs)
        u, w = model.plan.split(np.cumsum(step))
        at, kept = 0, r.kept
        for sweep in sweeps:
            size = int.from_bytes(kept[at : at + 8], "little")
            tables, *parent = L.get(kept[at + 8 : at + 8 + size])
            parent = L._unlogs(*parent)
            at += 8 + size
            words = sorted(set(w.tolist()))
            for a, b, c, t in zip(u.tolist(), w.tolist(), count.tolist(), tables.tolist()):
                assert (a, b) not in sweep and (t > 0) == (c > 0) and t <= c
                sweep[a, b] = (c, t, float(parent[words.index(b)]))
    # The last sweep's words: customers are the tables of the sweep before, and the predictive is the restaurant's.
    customers = {}
    for (a, b), (c, t, _) in sweeps[0].items():
        customers[b] = customers.get(b, 0) + t
    assert sum(customers.values()) == model.customers and sum(word_tables.values()) == model.tables
    for word, k in number.items():
        spelled = 10 ** model.spelling.log10(*letters([word]))[0]
        p = (max(customers.get(k, 0) - d1 * word_tables[word], 0) + (1 + d1 * model.tables) * spelled) / (1 + model.customers)
        assert all(abs(10**q - p) < 2e-3 * p for (a, b), (_, _, q) in sweeps[1].items() if b == k)
    for doc, text in rows:
        total, before = 0.0, model.plan.start
        for word in [*text.encode().split(), L.END]:
            w, mean = number[word], 0.0
            for sweep in sweeps:
                c_u = sum(c for (a, _), (c, _, _) in sweep.items() if a == before)
                t_u = sum(t for (a, _), (_, t, _) in sweep.items() if a == before)
                c, t, parent = sweep[before, w]
                mean += (max(c - d2 * t, 0) + (1 + d2 * t_u) * 10**parent) / (1 + c_u) / 2
            total, before = total + math.log10(mean), w
        assert abs(total - got[doc]) < 0.02, doc


def test_held_out_text_is_scored_better_than_by_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = L.scores(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    seen = Counter(x for r in rows if not r.held_out for x in r.text.split("\n"))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    own = [r for r in held if not any(x in seen for x in r.text.split("\n"))]
    assert len(own) > 300 and sum(r.score for r in own) > sum(r.base_score for r in own)


def test_a_text_held_twice_is_told_from_one_held_once(spark):
    import random

    rng = random.Random(4)
    words = ["w%d" % k for k in range(400)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(400)]
    rows = list(enumerate([*texts, *texts[:50]]))
    got = {r.doc_id: r.score / r.n_tokens for r in L.scores(spark.createDataFrame(rows, "doc_id long, text string"), modulus=10**9, remainder=-1).collect()}
    assert min(got[k] for k in range(50)) > max(got[k] for k in range(50, 400))


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")
    assert L.scores(df.limit(0)).count() == 0
    assert [r.n_tokens for r in L.scores(df).collect()] == [2, 2]
    none = L.scores(df, modulus=1, remainder=0).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.base_score) for r in none] == [(True, 0, 0, 0.0)] * 2
    assert np.isclose(none[0].score, 3 * math.log10(1 / 257), atol=2e-3)


def test_every_three_byte_event_has_its_dish(spark):
    """1.8 million events of words that occur once: after a context of such events alone, the predictive is known."""
    rng = np.random.default_rng(6)
    signs = np.array([x for x in range(33, 127) if not 65 <= x <= 90], np.uint8)
    words = np.unique(signs[rng.integers(0, len(signs), (260_000, 8))], axis=0)
    data = np.c_[words, np.full(len(words), 32, np.uint8)]
    rows = [(k, data[k::40].tobytes().decode()) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False)).withColumn("who", F.struct("doc_id", "held_out"))
    spelling = L.fitted(df.select("who", "held_out", "text"), word_bytes=500_000).spelling
    keys, counts = L.spelled_keys(words.ravel(), np.full(len(words), 8), np.ones(len(words), np.int64))
    assert len(keys) > 1_500_000
    _, at = np.unique(keys // L.SYMBOLS, return_inverse=True)
    once = np.flatnonzero((np.bincount(at, counts != 1) == 0)[at])[::50]
    n = np.bincount(at)[at][once]
    d = L.discount_of(int((counts == 1).sum()), int((counts == 2).sum()))
    want = (1 - d) / (1 + n) + (1 + d * n) / (1 + n) * spelling.predictive(keys[once] % L.SYMBOLS**3, 2)
    assert len(once) > 10_000 and np.allclose(spelling.predictive(keys[once], 3), want, rtol=1e-3)
