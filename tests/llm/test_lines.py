import functools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import lines as L
from tessera.llm.kernel import Hasher


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=800, deadline=None)
@given(st.text("ab", max_size=14), st.text("ab", max_size=14), st.integers(0, 4))
def test_banded_distance(a, b, most):
    assert L.edits_within(a.encode(), b.encode(), most) == (levenshtein(a, b) <= most)


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=40), st.text("ab", max_size=40), st.integers(9, 14))
def test_wide_distance(a, b, most):
    assert L.edits_within(a.encode(), b.encode(), most) == (levenshtein(a, b) <= most)


@functools.cache
def _cut(line):
    data = np.frombuffer(line, np.uint8)
    _, keys, count, _, _ = L.segments(Hasher(data), np.array([0]), np.array([len(line)]), *L.line_words(data, np.array([0, len(line)])))
    return len(set(keys.tolist())), count


def segments_of(line):
    return _cut(line)[0]


def most_edits(line):
    """Word edits that a line allows."""
    return int(L.word_edits(np.array([segments_of(line)]), _cut(line)[1])[0]) if len(line) >= L.LONG else 0


def near(a, b):
    """By words, for lines of this test, which are all long."""
    t, x, y = min(most_edits(a), most_edits(b)), L.split_words(a), L.split_words(b)
    return 0 < t >= abs(len(x) - len(y)) and len(set(x) - set(y)) <= t and levenshtein(x, y) <= t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "c", "dd", "e"]), max_size=30), st.lists(st.sampled_from(["ab", "c", "dd", "e"]), max_size=30), st.integers(1, 6))
def test_near_equal_by_words(a, b, t):
    assert L.near_equal(" ".join(a).encode() + b".", " ".join(b).encode() + b".", 2, t) == (levenshtein((" ".join(a) + ".").split(), (" ".join(b) + ".").split()) <= t)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.integers(12, 160))
def test_longer_lines_share_a_first_key_and_pass_the_sketch(seed, n):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(rng.choice([40, 3000]))]
    x = [rng.choice(words) for _ in range(n)]
    y = list(x)
    for _ in range(rng.randrange(1, 9)):
        at = rng.randrange(len(y))
        y[at : at + rng.randrange(2)] = rng.sample(words, rng.randrange(2))
    both = [" ".join(x).encode(), " ".join(y).encode()]
    if min(map(len, both)) < L.LONG or not near(*both) or both[0] == both[1]:
        return
    data = np.frombuffer(b"\n".join(both), np.uint8)
    s, e, _, _ = L.line_bounds(data, np.array([0, len(data)]))
    levels = np.random.default_rng(seed).integers(0, 5, L.SLOTS).astype(np.uint8)
    line, keys, sketch, _ = L.far_keys(Hasher(data), s, e, *L.line_words(data, np.array([0, len(data)])), levels)
    assert set(keys[line == 0].tolist()) & set(keys[line == 1].tolist())
    assert L.far_close(sketch[:1], sketch[1:])[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab \n\t\r", max_size=50), min_size=1, max_size=5))
def test_line_bounds(texts):
    raw = [t.encode() for t in texts]
    s, e, row, no = L.line_bounds(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = [(r, n, b"".join(raw)[a:b]) for a, b, r, n in zip(s.tolist(), e.tolist(), row.tolist(), no.tolist())]
    assert got == [(r, n, x.strip(b" \t\r")) for r, t in enumerate(raw) for n, x in enumerate(t.split(b"\n")) if x.strip(b" \t\r")]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=20, max_size=60), st.lists(st.tuples(st.sampled_from("ids"), st.integers(0, 70), st.integers(0, 255)), max_size=2))
def test_near_lines_share_a_key_and_pass_the_sketch(line, edits):
    other = bytearray(line)
    for op, at, b in edits:
        at %= len(other) + 1
        if op == "i":
            other.insert(at, b)
        elif at < len(other):
            if op == "d":
                del other[at]
            else:
                other[at] = b
    both = [line, bytes(other)]
    data = np.frombuffer(b"".join(both), np.uint8)
    s, e = np.array([0, len(line)]), np.array([len(line), len(data)])
    keys = [{}, {}]
    for which, found, role in L.line_keys(Hasher(data), s, e, 2):
        for w, k in zip(which, found):
            keys[w][k] = keys[w].get(k, 0) | role
    assert any((keys[0][k] & L.INDEX and keys[1][k] & L.PROBE) or (keys[1][k] & L.INDEX and keys[0][k] & L.PROBE) for k in keys[0].keys() & keys[1].keys())
    sketch = L.sketches(data, s, e)
    assert L.sketch_distance(sketch[:1], sketch[1:])[0] <= 4


def brute(rows, tau=2, least=20):
    """{(doc_id, no)} to drop."""
    place, texts = {}, []
    order = sorted(((d is not None, d or 0, t or "", d) for d, t in set(rows)))
    for _, _, text, doc in order:
        for no, line in enumerate(text.encode().split(b"\n")):
            if line.strip(b" \t\n\v\f\r"):
                texts.append((doc, no, line.strip(b" \t\n\v\f\r")))
    for doc, no, line in texts:
        place.setdefault(line, (doc, no))
    known = list(place)
    root = {x: x for x in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(known):
        for b in known[:i]:
            few = all(len(x) < L.LONG or segments_of(x) < L.MIXED for x in (a, b))
            if few and min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= tau and levenshtein(a, b) <= tau or min(len(a), len(b)) >= L.LONG and abs(len(a) - len(b)) < len(a) and near(a, b):
                root[find(a)] = find(b)
    first = {}
    for doc, no, line in texts:
        r, k = find(line), (doc is not None, doc or 0, no)
        if r not in first or k < first[r]:
            first[r] = k
    return {(doc, no) for doc, no, line in texts if first[find(line)] != (doc is not None, doc or 0, no)}


@pytest.mark.parametrize("block", [4, 1024])
def test_whole_table_against_brute_force(spark, block):
    rng = random.Random(5)
    base = ["the quick brown fox jumps over it %d" % k for k in range(6)] + ["short", "é" * 14, "item number 00001 of the list"]
    rows = []
    for d in range(60):
        picked = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                line[rng.randrange(len(line))] = rng.choice("abcz ")
            picked.append("".join(line))
        rows.append((d, "\n".join(picked)))
    rows += [(100, None), (101, ""), (102, "\n\n  \n"), (103, "x" * 900 + "\n" + "x" * 901), (None, base[0] + "\n" + base[0])]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, no int, id string")
    got = L.report(df, block=block).collect()
    assert len(got) == len(rows)
    dropped = {(r.doc_id, int(n)) for r in got for n in r.dropped.split(",") if n}
    assert dropped == brute(rows)
    assert all(r.n_exact + r.n_near == len([x for x in r.dropped.split(",") if x]) <= r.n_lines for r in got)
    out = L.deduplicated(df, block=block)
    assert out.columns == df.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    for doc, text in rows:
        want = None if text is None else "\n".join(x for no, x in enumerate(text.split("\n")) if (doc, no) not in dropped)
        assert kept[doc] == want


def test_real_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {(r.doc_id, int(n)) for r in L.report(docs).collect() for n in r.dropped.split(",") if n}
    place = {}
    for d, t in sorted(rows):
        for no, x in enumerate(t.split("\n")):
            if x.strip():
                place.setdefault(x.strip().encode(), (d, no))
    exact = {(d, no) for d, t in rows for no, x in enumerate(t.split("\n")) if x.strip() and place[x.strip().encode()] != (d, no)}
    assert exact <= got


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a\na"), (1, "a\na"), (2, "a")], "doc_id long, text string")
    assert sorted((r.doc_id, r.dropped) for r in L.report(df).collect()) == [(1, "1"), (1, "1"), (2, "0")]
    assert L.report(df.limit(0)).count() == 0 and L.deduplicated(df.limit(0)).count() == 0


def test_longer_lines_may_differ_in_words(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(4000)]
    rows = []
    for k in range(120):
        line = " ".join(rng.choices(words, k=rng.choice([13, 40, 150, 400])))
        cut = line.split(" ")
        for at in rng.sample(range(len(cut)), rng.randrange(1, max(2, len(cut) // 12))):
            cut[at] = rng.choice(words)
        rows += [(2 * k, line), (2 * k + 1, " ".join(cut))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in L.report(df).collect() if r.n_near}
    want = {2 * k + 1 for k in range(120) if near(rows[2 * k][1].encode(), rows[2 * k + 1][1].encode()) and rows[2 * k][1] != rows[2 * k + 1][1]}
    assert got == want and 50 < len(want) < 110
    spaceless = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(100))
    df = spark.createDataFrame([(1, spaceless), (2, spaceless[:50] + "abc" + spaceless[54:])], "doc_id long, text string")
    assert [r.n_near for r in L.report(df).orderBy("doc_id").collect()] == [0, 1]


@pytest.mark.parametrize("block", [8, 2])
def test_a_family_over_many_blocks(spark, block):
    """A hot family in small blocks, with keys over the hot level in the smallest ones: one chain that pivots can't see whole, and lines apart that only share its words."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(500)]
    stem = rng.choices(words, k=30)
    rows, line = [], list(stem)
    for k in range(60):  # each differs from the one before in a word of another place
        line = list(line)
        line[k % 30] = words[100 + k]
        rows.append(" ".join(line))
    for k in range(30):  # the same first words, all else different
        rows.append(" ".join(stem[:8] + rng.sample(words[200:], 25)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id for r in L.report(df, block=block).collect() if r.n_near}
    label = list(range(len(rows)))
    for i, a in enumerate(rows):
        for j in range(i):
            if near(a.encode(), rows[j].encode()):
                old, new = sorted((label[i], label[j]), reverse=True)
                label = [new if x == old else x for x in label]
    assert got == {i for i, x in enumerate(label) if x != i} and len(got) == 59


def test_words_of_wide_characters():
    text = "ab \u4e2d\u6587c d\U00020000\u00e9 e".encode()
    s, e = L.line_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert [text[a:b].decode() for a, b in zip(s, e)] == ["ab", "\u4e2d", "\u6587", "c", "d", "\U00020000", "\u00e9", "e"]


def test_long_texts_and_many_lines(spark):
    """A text of many lines and a line of a million bytes: linear in both."""
    long_line = " ".join(str(k * k) for k in range(150_000))
    many = "\n".join(f"entry {k} of a very long list of things" for k in range(30_000))
    df = spark.createDataFrame([(1, long_line), (2, "x " + long_line), (3, many), (4, many)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.report(df).collect()}
    assert got[2].n_near == 1 and got[4].n_exact == 30_000 and got[1].n_near == 0


def test_large_groups_are_compared_in_little_memory():
    """One Arrow batch of 18 full groups of copies: pairs are held for a few groups at a time, and hashes for a slice of text."""
    import tracemalloc

    import pyarrow as pa

    groups, size = 18, 530
    rng = random.Random(8)
    lines = []
    for _ in range(groups):
        words = ["w%d" % rng.randrange(10**6) for _ in range(40)]
        lines += [" ".join([*words[: k % 40], "x%d" % k, *words[k % 40 + 1 :]]).encode() for k in range(size)]
    data, at = np.frombuffer(b"".join(lines), np.uint8), np.cumsum([0, *map(len, lines)])
    hasher = Hasher(data)
    _, _, sketch, _ = L.far_keys(hasher, at[:-1], at[1:], *L.line_words(data, at), np.zeros(L.SLOTS, np.uint8))
    n = len(lines)
    group, zero = np.repeat(np.arange(groups), size), np.zeros(n, np.int64)
    columns = [pa.array(x) for x in (group, zero, zero, np.arange(n), sketch.view(np.int64), np.arange(n), zero > 0)] + [pa.array(lines, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, ["key", "block", "part", "id", "sketch", "root", "guest", "line"])
    tracemalloc.start()
    try:
        links = [(a, b) for out in L._verified(iter([batch]), 2, False) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(links) == n - groups and all(a // size == b // size for a, b in links)
    assert peak < 80 << 20, peak


def test_word_bits_do_not_depend_on_the_slices():
    import pyarrow as pa

    rng = random.Random(9)
    lines = [b"", b" ".join(b"w%d" % rng.randrange(99) for _ in range(80_000)), *(b" ".join(b"v%d" % rng.randrange(999) for _ in range(9)) for _ in range(9000))]
    got = L.word_bits(pa.array(lines, pa.binary()).slice(1))
    assert len(got) == len(lines) - 1 and all(np.array_equal(got[k - 1], L.word_bits(pa.array([lines[k]], pa.binary()))[0]) for k in (1, 2, 4000, 9001))
