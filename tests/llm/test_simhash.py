import numpy as np
import xxhash

from tessera.llm import simhash as S


def brute_fp(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {ids[i]: min(groups[find(i)]) for i in range(len(ids))}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    rows += [(10_000, None), (10_001, ""), (10_002, "A b"), (10_003, "a  B"), (10_004, "x")]
    df = spark.createDataFrame([(r[0], r[1], 1, "k") for r in rows], "doc_id long, text string, fp int, key string")
    got = {r.doc_id: r for r in S.near_duplicates(df, block=8).collect()}
    fps = [brute_fp(r[1]) for r in rows]
    want = brute_components([r[0] for r in rows], fps)
    assert {k: r.fingerprint for k, r in got.items()} == {r[0]: f"{f:016x}" for r, f in zip(rows, fps)}
    assert {k: r.component_id for k, r in got.items()} == want


def test_ring_finds_every_pair_of_three_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    y = x.copy()
    for k in range(3000):
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    shared = (S.ring_keys(x) == S.ring_keys(y))
    chained = np.array([[S.chain_ok(np.array([x[k] ^ y[k]]), np.array([s]))[0] for s in range(8)] for k in range(300)])
    assert shared.any(axis=1).all() and chained.any(axis=1).all()


def test_large_groups_split_into_blocks(spark):
    base = 0x0123456789ABCDEF
    fps = [base ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)]
    df = spark.createDataFrame([(f if f < 2**63 else f - 2**64,) for f in fps], "fp long")
    from tessera.llm.common import components

    roots = {r.root for r in components(S.near_links(df, block=16)).collect()}
    assert len(roots) == 1


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert [r.component_id for r in S.near_duplicates(twice).collect()] == [1, 1, 1]


def test_long_texts(spark):
    text = "some words that come again and again in a long text " * 100_000
    df = spark.createDataFrame([(1, text), (2, text + "end"), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in S.near_duplicates(df).collect()}
    assert got[1].component_id == got[2].component_id == 1 and got[3].component_id == 3 and got[1].fingerprint == f"{brute_fp(text):016x}"
