import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tests.llm.test_decontaminate import brute_windows
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import brute_components, brute_fp
from tessera.llm import quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A few documents, as the brute-force line join compares all pairs of lines."""
    top = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 600")
    docs.write.parquet(f"{top}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{top}/{t}.parquet")
    return str(top)


def test_run_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    good = {r["__row"].doc_id for r in quality.score(docs, model).collect() if r.score >= 0.3}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    dropped = brute_lines(rows)
    rows = [(d, "\n".join(x for no, x in enumerate(t.split("\n")) if (d, no) not in dropped)) for d, t in rows]
    group = brute_components([d for d, _ in rows], [brute_fp(t, 5) for _, t in rows])
    rows = [(d, t) for d, t in rows if group[d] == d]
    for literal in (False, True):
        items = [x for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() if (x := brute_windows(r.text, literal))]
        rows = [(d, t) for d, t in rows if not any(len(x & brute_windows(t, literal)) >= 0.8 * len(x) for x in items)]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, small).collect()}
    assert got == {d: lib.encode(t) for d, t in rows} and got


def test_stages_keep_columns_and_clean_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.count() > 0.5 * docs.count()
        assert stage(spark, docs.limit(0), small).count() == 0


def test_stages_take_nulls_long_texts_repeated_rows_and_any_columns(spark, small):
    long_text = " ".join("word%d of a long text" % k for k in range(20_000))
    rows = [(1, None), (2, ""), (3, long_text), (3, long_text), (None, "a text without an id, of some words"), (4, "\n\n"), (5, "tie"), (6, "tie")]
    docs = spark.createDataFrame([(*r, "x", 7, 1.5) for r in rows], "doc_id long, text string, key string, __row int, score double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.count() <= len(rows), name
        kept = [r for r in out.collect() if r.doc_id == 3]
        assert all(r.key == "x" and r["__row"] == 7 for r in kept)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == len(rows)
