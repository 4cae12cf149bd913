"""Held-out accuracy, and that it comes from the labels."""

import zlib

import duckdb
import numpy as np
import pyarrow as pa

from metrikon.llm import quality
from metrikon.llm.common import strings

SF = "/root/testdata/sf0.1"


def auc(s, y):
    rank, n1 = np.argsort(np.argsort(s)), y.sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def test_held_out():
    rows = duckdb.sql(f"SELECT doc_id, text, quality FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id) ORDER BY doc_id LIMIT 1500").fetchall()
    held = lambda r: zlib.crc32(str(r[0]).encode()) % 3 == 1
    learn = [r for r in rows if not held(r)]
    texts = {r[1] for r in learn}
    test = [r for r in rows if held(r) and r[1] not in texts]  # copies of trained texts prove nothing
    flat, offsets = strings(pa.array([r[1] for r in test]))
    y = np.array([r[2] for r in test])
    model = quality.train([r[1] for r in learn], [r[2] for r in learn])
    assert auc(model.score(flat, offsets), y) > 0.9
    twice = int(quality.mix(np.zeros(1, np.uint64))[0]) >> 64 - quality.BITS  # a word twice in a row: what its weight is, labels alone decide
    mixed = np.random.default_rng(0).permutation([r[2] for r in learn]).tolist()
    other = quality.train([r[1] for r in learn], mixed)
    assert auc(other.score(flat, offsets), y) < 0.75
    spread = model.weights.std()
    assert model.weights[twice] < -5 * spread and model.weights[twice] < 4 * other.weights[twice]


def plain_features(text):
    """The buckets of a text's features, one after the other."""
    h = {}

    def word(w):
        if w not in h:
            flat = np.frombuffer(w, np.uint8)
            h[w] = int(quality.word_hashes(flat, np.zeros(1, np.int64), 51)[0])
        return h[w]

    def gram(codes):
        key = len(codes)
        for c in codes:
            key = (key * 0x01000193 & 0xFFFFFFFF) ^ c
        return (key * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - quality.BITS

    w = text.encode().split()
    out = [word(x) >> 64 - quality.BITS for x in w]
    out += [int(quality.mix(np.array([word(a) ^ word(b)], np.uint64))[0]) >> 64 - quality.BITS for a, b in zip(w, w[1:], strict=False)]
    for n in quality.GRAMS:
        for x in w:
            marked = [0, *map(ord, x.decode()), 0]
            out += [gram(marked[i : i + n]) for i in range(len(marked) - n + 1)]
    return sorted(out)


TEXTS = ["", " ", "a", "ab cd", "été été\tgo  go\n", "x", "日本 語 a\x0bb", "one two three " * 30]


def test_features_and_scores_by_hand():
    flat, offsets = strings(pa.array(TEXTS))
    families = list(quality.features(flat, offsets))
    for i, t in enumerate(TEXTS):
        assert sorted(b for f, first in families for b in f[first[i] : first[i + 1]].tolist()) == plain_features(t), t
    weights = np.random.default_rng(0).normal(size=1 << quality.BITS).astype(np.float32)
    for t, s in zip(TEXTS, quality.Model(weights, 0.3).score(flat, offsets), strict=True):
        f = plain_features(t)
        assert np.isclose(s, 1 / (1 + np.exp(-(float(weights[f].sum()) / max(1, len(f)) + 0.3))))


def test_step_and_folding_by_hand():
    """A step goes down the gradient of the log loss; the folded weights give the softmax of the unfolded model."""
    rng = np.random.default_rng(1)
    vectors, out, bias = (rng.normal(size=n).astype(np.float32) for n in ((1 << quality.BITS, quality.DIMS), (2, quality.DIMS), 2))
    ids, share = quality.bag("one two two three")

    def loss(v, o, b):
        z = o @ (share @ v[ids]) + b
        return float(np.log(np.exp(z - z.max()).sum()) + z.max() - z[1])

    new = [x.astype(float) for x in (vectors, out, bias)]
    old, eps = [x.copy() for x in new], 1e-6
    quality.descend(*new, ids, share, 1, 0.01)
    for which, scale in ((0, 0.01 / float(share @ share)), (1, 0.01), (2, 0.001)):
        for at in (ids[:2] if which == 0 else range(2)):
            moved = [x.copy() for x in old]
            spot = (at, 3) if which < 2 else at
            moved[which][spot] += eps
            slope = (loss(*moved) - loss(*old)) / eps
            assert np.isclose(old[which][spot] - new[which][spot], scale * slope, rtol=1e-2, atol=1e-7)
    model = quality.Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))
    flat, offsets = strings(pa.array(["one two two three"]))
    z = out @ (share @ vectors[ids]) + bias
    assert np.isclose(model.score(flat, offsets)[0], np.exp(z[1]) / np.exp(z).sum(), rtol=1e-4)


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: seen.append(texts))
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('x', 100) AS text")
    quality.fit(docs, docs.selectExpr("doc_id", "1 AS quality"), sample_bytes=1050)
    assert seen == [["x" * 100] * 10]
