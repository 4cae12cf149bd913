"""Quality classifier by supervised subword embeddings.

Hashed words, pairs of neighbouring words and character n-grams of words (their borders
marked) have learned vectors; a document is the mean of its features' vectors under a
softmax, trained by stochastic gradient descent in numpy. A pair's hash is the exclusive
or of its words', so pairs have no order and any word twice in a row is one feature,
whose vector is learned like all others. As the output is linear in the mean, the trained
vectors fold into one number for each bucket, and scoring whole texts is one gather and
sum for each feature.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, mix, spans, strings, word_hashes, words

BITS, DIMS, GRAMS = 18, 8, (3, 4)
#: The bounds of the training sample: so many labelled rows, those of least hash of doc_id, and so many bytes of their texts.
SAMPLE, SAMPLE_BYTES = 2500, 64 << 20
EPOCHS, RATE = 4, 0.25
CHUNK = 1 << 20


def gram_key(codes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each place."""
    m = max(len(codes) - n + 1, 0)
    key = np.full(m, n, np.uint32)
    for k in range(n):
        key = key * np.uint32(0x01000193) ^ codes[k : k + m]
    return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def characters(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, each row after a zero, with a zero at the end; white space is zero too. And where each row's zero is (n + 1 long)."""
    codes = np.frombuffer(flat.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])[offsets]
    codes = np.where((codes == 32) | ((codes >= 9) & (codes <= 13)), np.uint32(0), codes)
    return np.insert(codes, before, np.uint32(0)), before + np.arange(len(offsets))


def features(flat: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Families of (bucket of each feature, for each row the number of features before it, n + 1 long)."""
    starts, _, first = words(flat, offsets)
    h = word_hashes(flat, starts, 51)
    yield (h >> U64(64 - BITS)).astype(np.uint32), first
    inner = np.ones(max(len(h) - 1, 0), bool)
    inner[(e := first[1:-1] - 1)[(e >= 0) & (e < len(inner))]] = False
    pair = mix((h[1:] ^ h[:-1])[inner])
    yield (pair >> U64(64 - BITS)).astype(np.uint32), np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - 1, 0))])
    codes, begin = characters(flat, offsets)
    inside = codes != 0
    for n in GRAMS:
        key = gram_key(codes, n)
        whole = np.ones(len(key), bool)  # a border may stand at either end alone
        for k in range(1, n - 1):
            whole &= inside[k : k + len(key)]
        before = np.concatenate([[0], np.cumsum(whole)])
        yield key[whole], before[np.minimum(begin, len(key))]


@dataclass
class Model:
    """Folded weights of the buckets and a bias: the log-odds of label 1."""

    weights: np.ndarray
    bias: float

    def score(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
        for bucket, first in features(flat, offsets):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[bucket], dtype=np.float64)])
            total += sums[first[1:]] - sums[first[:-1]]
            count += np.diff(first)
        z = np.clip(total / np.maximum(count, 1) + self.bias, -40, 40)
        return 1 / (1 + np.exp(-z))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and the share of its features in each."""
    flat = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    ids, counts = np.unique(np.concatenate([b for b, _ in features(flat, np.array([0, len(flat)]))]), return_counts=True)
    return ids, (counts / max(1, counts.sum())).astype(np.float32)


def descend(vectors: np.ndarray, out: np.ndarray, bias: np.ndarray, ids: np.ndarray, share: np.ndarray, label: int, rate: float) -> None:
    """One step of gradient descent on the log loss of one document, in place."""
    hidden = share @ vectors[ids]
    logits = out @ hidden + bias
    p = np.exp(logits - logits.max())
    p /= p.sum()
    p[label] -= 1
    back = p @ out
    out -= np.float32(rate) * np.outer(p, hidden)
    bias -= np.float32(0.1 * rate) * p
    # normalised step: the mean vector moves by the rate times its gradient, however many features share it
    vectors[ids] -= np.float32(rate / max(float(share @ share), 1e-6)) * np.outer(share, back)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Learns vectors and the softmax layer. One class alone gives its share, smoothed, for any text."""
    y = np.array(labels, np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    if len(set(labels)) < 2:
        return model
    bags = [bag(text) for text in texts]
    rng = np.random.default_rng(seed)
    vectors = (rng.random((1 << BITS, DIMS), np.float32) - 0.5) / DIMS
    out, bias = np.zeros((2, DIMS), np.float32), np.zeros(2, np.float32)
    # classes weigh alike up to this power, so that the rarer one is learned
    weight = (len(y) / (2 * np.bincount(y, minlength=2))) ** 0.5
    step, steps = 0, EPOCHS * len(y)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            descend(vectors, out, bias, *bags[i], y[i], RATE * (1 - step / steps) * weight[y[i]])
            step += 1
    model.weights = (vectors @ (out[1] - out[0])).astype(np.float32)
    model.bias = float(bias[1] - bias[0])
    return model


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from at most ``sample`` labelled rows that are not held out, one text (the least) of each doc_id, as many as fit in ``sample_bytes``.

    Null labels and texts of unlabelled rows take no part.
    """
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    wanted = wanted.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("y").alias("y"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so many rows at most, so they can be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    inside = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over the bounded sample
    rows = rows.withColumn("upto", F.sum(F.octet_length("text")).over(inside)).where(F.col("upto") <= sample_bytes).drop("upto").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    return train([r[2] for r in rows], [r[1] for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): every whole text; a null or empty text has the score of the bias."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            flat, offsets = strings(b.column(1))
            found = [own.score(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in spans(offsets, CHUNK)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; repeated rows stay, null ids are not held out."""
    x = score(docs, fit(docs, labels))
    return x.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows predicted 1, with all their columns; the texts are scored where they lie, without a join. Null texts score as empty ones; null ids and repeated rows are rows like others."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            flat, offsets = strings(b.column(where))
            good = [own.score(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) >= 0.5 for lo, hi in spans(offsets, CHUNK)]
            yield b.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
