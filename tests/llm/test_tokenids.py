import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import tokenids as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400), st.sampled_from([1, 3, 8]), st.sampled_from([1, 4, 7]))
def test_round_trip_and_checkpoints(ids, lanes, every):
    ids = np.array(ids, np.uint32)
    table = T.Table.of_counts(np.bincount(ids, minlength=301) * 1000)
    block = T.encode(ids, table, lanes, every)
    assert np.array_equal(T.decode(block, table), ids)
    for a, b in ((0, 5), (len(ids) // 2, len(ids)), (len(ids) // 3, len(ids) // 3 + 9)):
        assert np.array_equal(T.decode(block, table, a, b), ids[a:b])


def test_size_is_near_the_entropy_and_damage_is_seen():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.zipf(1.3, 400_000), 50_000).astype(np.uint32)
    counts = np.bincount(ids)
    table = T.Table.of_counts(counts)
    block = T.encode(ids, table)
    p = counts[counts > 0] / len(ids)
    assert len(block) * 8 < 1.04 * len(ids) * -(p * np.log2(p)).sum()
    assert np.array_equal(T.decode(block, table), ids)
    with pytest.raises(ValueError):
        T.decode(block[:-3] + b"abc", table)


def test_many_rare_ids_fit_the_table():
    counts = np.ones(60_000, np.int64)
    counts[:5] = 10**9
    assert int(T.Table.of_counts(counts).freq.sum()) == 1 << T.BITS


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet="abAZ é's1.,!?;\n\t \u00a0\u2003\u3000\r漢\u2019", max_size=30), min_size=1, max_size=4))
def test_units_equal_the_whole(texts):
    lib = Tokenizer.from_file(PATH)
    raw = [t.encode() for t in texts]
    ids, at = T._encoder(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])], 2)
    got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert got == [lib.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_contract_on_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(900, None), (901, ""), (902, "x <|endoftext|> y"), (-5, "first  of\n all")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.text) for r in docs.union(more).collect())
    got = sorted(T.round_trip(docs.union(more).repartition(5), PATH).collect())
    lib, at = Tokenizer.from_file(PATH), 0
    for (doc, text), r in zip(rows, got, strict=True):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b c")], "doc_id long, text string")
    assert sorted(r.start for r in T.round_trip(df, PATH).collect()) == [0, 3, 5]
    assert T.round_trip(df.limit(0), PATH).count() == 0


def test_the_files_stand_alone(spark, tmp_path):
    """Another session's reader has the written table of blocks, nothing else."""
    rows = [(k, "word %d and more " % (k % 7) * (k + 1)) for k in range(50)]
    tokens, kind = T.tokenized(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    tokens = tokens.cache()
    blocks = T.write_blocks(tokens, T.shared_table(tokens), kind, block=500)
    path = blocks._tessera_path
    got = {r.doc_id: r.n_tokens for r in T.read_blocks(spark.read.parquet(path)).collect()}
    lib = Tokenizer.from_file(PATH)
    assert got == {k: len(lib.encode(t, add_special_tokens=False).ids) + 1 for k, t in rows}
    raw = blocks.filter("part = -1").first().payload
    assert np.array_equal(T.Table.from_bytes(bytes(raw)).freq, T.shared_table(tokens).freq)
    with pytest.raises(ValueError):
        T.Table.from_bytes(bytes(raw[:-1]) + b"\x07")
    with pytest.raises(ValueError):
        T.read_blocks(spark.read.parquet(path).filter("part >= 0"))


def test_long_texts_and_other_columns(spark):
    text = "a few words, then some more.\n" * 40_000
    df = spark.createDataFrame([(2, text, "x", 5), (1, "日本" * 200_000, None, 6)], "doc_id long, text string, ids string, part int")
    lib = Tokenizer.from_file(PATH)
    got = T.round_trip(df, PATH).orderBy("doc_id").collect()
    sizes = [len(lib.encode(t, add_special_tokens=False).ids) + 1 for t in ("日本" * 200_000, text)]
    assert [(r.start, r.n_tokens) for r in got] == [(0, sizes[0]), (sizes[0], sizes[1])]
