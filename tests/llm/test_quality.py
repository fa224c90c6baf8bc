import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality as Q


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    x, bounds, y = rng.normal(size=(9, Q.N_FEATURES)), np.array([0, 2, 5, 9]), np.array([0.0, 1.0, 1.0])
    bag = np.repeat(np.arange(3), np.diff(bounds))
    h = Q.HIDDEN
    p = {"W": rng.normal(size=(Q.N_FEATURES, h)) * 0.2, "b": rng.normal(size=h), "V": rng.normal(size=(h, h)), "U": rng.normal(size=(h, h)), "w": rng.normal(size=h), "c": rng.normal(size=h), "d": rng.normal(size=1)}
    loss = lambda: float(-np.mean(y * np.log(o := Q.Attention._forward(p, x, bounds, bag)[-1]) + (1 - y) * np.log(1 - o)))
    grads = Q.Attention._gradient(p, x, bounds, bag, y)
    for k in p:
        at = tuple(0 for _ in p[k].shape)
        p[k][at] += 1e-6
        up = loss()
        p[k][at] -= 2e-6
        down = loss()
        p[k][at] += 1e-6
        assert abs((up - down) / 2e-6 - grads[k][at]) < 1e-6, k


def test_passages_cover_whole_texts():
    texts = [b"", b"one two", b"x" * 100_000, "é ß ".encode() * 500]
    at = np.r_[0, np.cumsum([len(t) for t in texts])]
    x, bounds = Q.passages(np.frombuffer(b"".join(texts), np.uint8), at)
    assert np.diff(bounds).tolist() == [1, 1, 64, 5] and np.allclose(x[1:, :16].sum(axis=1), 1) and not x[0].any()
    alone, _ = Q.passages(np.frombuffer(texts[3], np.uint8), np.array([0, len(texts[3])]))
    assert np.allclose(alone, x[bounds[3] :])


def test_a_long_row_is_encoded_by_passages():
    text = np.frombuffer(b"some words of a long text. " * 400_000, np.uint8)
    x, bounds = Q.passages(text, np.array([0, len(text)]))
    assert bounds.tolist() == [0, 64] and np.allclose(x[:, :16].sum(axis=1), 1)


def test_scores_against_a_plain_scorer():
    """The vectorised score of a bag equals one written out passage by passage."""
    rng = np.random.default_rng(2)
    x, bounds = rng.normal(size=(12, Q.N_FEATURES)).astype(np.float32), np.array([0, 1, 5, 12])
    model = Q.Attention.fit(x, bounds, np.array([0.0, 1.0, 0.0]), steps=5)
    got, weight = model.predict(x, bounds)
    for k in range(3):
        h = [np.tanh(np.clip((row - model.mean) / model.scale, -6, 6) @ model.params["W"] + model.params["b"]) for row in x[bounds[k] : bounds[k + 1]]]
        raw = np.array([(np.tanh(v @ model.params["V"]) / (1 + np.exp(-(v @ model.params["U"])))) @ model.params["w"] for v in h])
        a = np.exp(raw) / np.exp(raw).sum()
        z = sum(w * v for w, v in zip(a, h))
        assert np.isclose(got[k], 1 / (1 + np.exp(-(z @ model.params["c"] + model.params["d"][0])))) and np.isclose(weight[k], a.max())


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = Q.classify(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    known = [r for r in got if r.held_out and r.quality is not None]
    right = np.mean([r.predicted == r.quality for r in known])
    best, worst = [r.score for r in known if r.quality == 1], [r.score for r in known if r.quality == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in best for b in worst])
    assert right > 0.9 and auc > 0.9, (right, auc)


def test_nulls_empty_and_clashing_names(spark):
    rows = [(1, None, 0.5, "a"), (2, "", 0.5, "b"), (None, "text here", 0.1, "c"), (2, "", 0.5, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, __row string")
    labels = spark.createDataFrame([(1, None), (2, 1), (None, 0)], "doc_id long, quality int")
    assert Q.classify(docs, labels).count() == 4
    kept = Q.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 4
    assert Q.classify(docs.limit(0), labels.limit(0)).count() == 0
    assert Q.classify(docs, labels.filter(F.lit(False))).first().score == 0.5
