"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages; only the bag has a label. Every passage is encoded by itself, by character-class shares,
word statistics and a hashed bag of its words, all lifted by a tanh layer that is learnt from the labels too; it is given
a gated attention weight, and the weighted mean passage is scored by a logistic output. The passages cover the whole text:
a passage has PASSAGE bytes, or a 64th of a longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held_out_expr, id_text, load, text_buffers, trim
from tessera.llm.kernel import Hasher, slices, word_bounds

PASSAGE = 600
MOST_PASSAGES = 64
LONG_ROW = 4 << 20
SAMPLE = 8_000  # labelled documents that the model is fitted on, at most
HIDDEN = 12
THRESHOLD = 0.3

# Byte classes: upper, lower, digit, space, line end, stop, comma, bang, hash/star, money/percent/amp, bar, bracket, quote, dash, other ASCII, beyond ASCII.
_CLASSES = 16
_STATISTICS = _CLASSES + 9
WORD_BUCKETS = 32
N_FEATURES = _STATISTICS + WORD_BUCKETS


def _class_table() -> np.ndarray:
    out = np.full(256, 14, np.uint8)
    for k, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "#*", "$%&", "|", "()[]{}<>", "\"'`", "-_/")):
        out[[ord(c) for c in chars]] = k
    out[128:] = 15
    return out


CLASS = _class_table()


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features [n, N_FEATURES] of the passages of some rows, and the bounds of each row's passages; no row has none."""
    sizes = np.diff(offsets)
    width = np.maximum(PASSAGE, -(-sizes // MOST_PASSAGES))
    if len(sizes) == 1 and sizes[0] > LONG_ROW:  # one passage at a time; a word over a bound is two
        parts = [_encoded(data[k : k + width[0]], np.array([0, min(width[0], len(data) - k)]), width)[0] for k in range(0, len(data), int(width[0]))]
        return np.concatenate(parts), np.array([0, len(parts)])
    return _encoded(data, offsets, width)


def _encoded(data: np.ndarray, offsets: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(offsets)
    each = np.maximum(1, -(-sizes // width))
    bounds = np.r_[0, np.cumsum(each)]
    total = int(bounds[-1])
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    where = np.arange(len(data)) - offsets[row_of]
    at = bounds[row_of] + where // width[row_of]
    counts = np.bincount(at * _CLASSES + CLASS[data], minlength=total * _CLASSES).reshape(total, _CLASSES).astype(np.float64)
    length = counts.sum(axis=1)
    per = 1 / np.maximum(length, 1)
    out = np.zeros((total, N_FEATURES), np.float32)
    out[:, :_CLASSES] = counts * per[:, None]
    if len(data):
        same = np.zeros(len(data), np.float64)
        same[1:] = data[1:] == data[:-1]
        out[:, 16] = np.bincount(at, same, total) * per
        s, e, row = word_bounds(data, offsets)
        word_at, word_len = at[s], (e - s).astype(np.float64)
        n = np.bincount(word_at, minlength=total).astype(np.float64)
        per_word = 1 / np.maximum(n, 1)
        mean = np.bincount(word_at, word_len, total) * per_word
        out[:, 17] = mean / 8
        out[:, 18] = np.sqrt(np.maximum(np.bincount(word_at, word_len**2, total) * per_word - mean**2, 0)) / 8
        hashes = Hasher(data)(s, e)
        with np.errstate(over="ignore"):
            keyed = hashes ^ (word_at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            kept = np.unique(keyed, return_index=True)[1]
            out[:, 19] = np.bincount(word_at[kept], minlength=total) * per_word
        again = np.zeros(len(s))
        if len(s) > 1:
            again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        out[:, 20] = np.bincount(word_at, again, total) * per_word
        first, last = CLASS[data[s]], CLASS[data[e - 1]]
        out[:, 21] = np.bincount(word_at, first == 0, total) * per_word
        out[:, 22] = np.bincount(word_at, last > 6, total) * per_word
        out[:, 23] = np.bincount(word_at, word_len <= 2, total) * per_word
        out[:, 24] = np.bincount(word_at, word_len >= 12, total) * per_word
        bag = np.bincount(word_at * WORD_BUCKETS + (hashes >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS, minlength=total * WORD_BUCKETS)
        out[:, _STATISTICS:] = np.sqrt(bag.reshape(total, WORD_BUCKETS) * per_word[:, None])
    return out, bounds


class Attention:
    """Gated attention: h = tanh(xW + b), a = softmax of w . (tanh(hV) * sigmoid(hU)) in a bag, p = sigmoid(c . sum(a h) + d)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, params: dict[str, np.ndarray]):
        self.mean, self.scale, self.params = mean, scale, params

    @classmethod
    def fit(cls, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Attention:
        x = x.astype(np.float64)
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        x = np.clip((x - mean) / scale, -6, 6)
        rng = np.random.default_rng(seed)
        d, h = x.shape[1], HIDDEN
        p = {"W": rng.normal(0, d**-0.5, (d, h)), "b": np.zeros(h), "V": rng.normal(0, h**-0.5, (h, h)), "U": rng.normal(0, h**-0.5, (h, h)), "w": rng.normal(0, 0.3, h), "c": rng.normal(0, 0.3, h), "d": np.zeros(1)}
        first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        bag = np.repeat(np.arange(len(y)), np.diff(bounds))
        for t in range(1, steps + 1):
            grads = cls._gradient(p, x, bounds, bag, y)
            for k, g in grads.items():
                g = g + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
        return cls(mean, scale, p)

    @staticmethod
    def _forward(p: dict, x: np.ndarray, bounds: np.ndarray, bag: np.ndarray):
        hidden = np.tanh(x @ p["W"] + p["b"])
        left, right = np.tanh(hidden @ p["V"]), 1 / (1 + np.exp(-(hidden @ p["U"])))
        raw = (left * right) @ p["w"]
        raw = raw - np.maximum.reduceat(raw, bounds[:-1])[bag]
        weight = np.exp(raw)
        weight /= np.add.reduceat(weight, bounds[:-1])[bag]
        z = np.add.reduceat(weight[:, None] * hidden, bounds[:-1], axis=0)
        return hidden, left, right, weight, z, 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))

    @classmethod
    def _gradient(cls, p: dict, x: np.ndarray, bounds: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        hidden, left, right, weight, z, out = cls._forward(p, x, bounds, bag)
        miss = (out - y) / len(y)
        gz = miss[:, None] * p["c"]
        gw = (hidden * gz[bag]).sum(axis=1)
        graw = weight * (gw - np.add.reduceat(weight * gw, bounds[:-1])[bag])
        gleft, gright = graw[:, None] * p["w"] * right * (1 - left**2), graw[:, None] * p["w"] * left * right * (1 - right)
        gh = weight[:, None] * gz[bag] + gleft @ p["V"].T + gright @ p["U"].T
        gpre = gh * (1 - hidden**2)
        return {"W": x.T @ gpre, "b": gpre.sum(axis=0), "V": hidden.T @ gleft, "U": hidden.T @ gright, "w": (left * right).T @ graw, "c": z.T @ miss, "d": miss.sum(keepdims=True)}

    def predict(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag and its largest attention weight."""
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        bag = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        *_, weight, _, out = self._forward(self.params, x, bounds, bag)
        return out, np.maximum.reduceat(weight, bounds[:-1])


class Constant:
    """Where there are no labels of both kinds: their mean, or one half."""

    def __init__(self, value: float):
        self.value = value

    def predict(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(bounds) - 1
        return np.full(n, self.value), np.ones(n)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE):
    """Fit on at most `sample` labelled documents, those of the least hash of their id; none whose crc32(id) mod 5 is 0.

    Of repeated labels of an id the least counts, and of repeated documents one; null labels and ids are left out.
    """
    key = F.col(id_col)
    marked = labels.filter(key.isNotNull() & F.col(label_col).isNotNull() & ~held_out_expr(key, 5, 0)).groupBy(key.alias("doc_id")).agg(F.min(label_col).cast("int").alias("y"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    bags = id_text(docs, id_col, text_col).join(F.broadcast(marked), "doc_id").select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in slices(*text_buffers(batch.column("text"))):
                x, bounds = passages(data, at)
                rows = [x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])

    kind = dict(bags.dtypes)["doc_id"]
    # One row for each id, so that no more than the sample comes here.
    rows = bags.mapInArrow(run, f"doc_id {kind}, y int, x binary").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).orderBy("doc_id").collect()
    y = np.array([r.y for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return Constant(float(y.mean()) if len(y) else 0.5)
    x = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in rows]
    return Attention.fit(np.concatenate(x), np.r_[0, np.cumsum([len(b) for b in x])], y)


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, score, attention (its largest weight) for each row; with keep, all columns of docs and `score`.

    A null or empty text is one empty passage and has a score too; repeated rows are kept. No shuffle.
    """
    # The text goes first under names of our own, so that no column of docs can clash.
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.struct(*docs.columns).alias("__row")) if keep else id_text(docs, id_col, text_col).select(F.col("text").alias("__text"), F.struct("doc_id").alias("__row"))
    kind = rows.schema["__row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, weights = [], []
            for _, _, data, at in slices(*text_buffers(batch.column(0))):
                a, b = model.predict(*passages(data, at))
                scores.append(a)
                weights.append(b)
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.concatenate(scores)), pa.array(np.concatenate(weights))], ["__row", "score", "attention"])
        trim()

    return rows.mapInArrow(run, f"__row {kind}, score double, attention double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, attention for every row of docs."""
    scored = score(docs, fit(docs, labels, id_col, text_col, sample=sample), id_col, text_col)
    doc_id = F.col("__row.doc_id")
    return scored.select(doc_id.alias("doc_id"), held_out_expr(doc_id, 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "attention")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with the columns of docs, whose score is at least THRESHOLD.

    A null or empty text is judged as one empty passage; repeated rows are judged alike; without labels of both kinds all
    have the same score; an empty table stays empty. Columns of any name pass through.
    """
    scored = score(docs, fit(docs, labels, id_col, text_col), id_col, text_col, keep=True)
    return scored.filter(F.col("score") >= THRESHOLD).select("__row.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
