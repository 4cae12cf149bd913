"""Importance resampling against plain code, one feature at a time."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from metrikon.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def brute(docs, target):
    s, t = Counter(b for _, x in docs for b in grams(x)), Counter(b for x in target for b in grams(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    rows = []
    for i, x in docs:
        f = grams(x)
        w = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    drawn = able[: 25 * len(able) // 100]
    return sorted([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in able[len(drawn) :]] + [(*r, None) for r in rows if r[1] < 39], key=str)


r = random.Random(2)
LEXICON = ["alpha", "Beta", "ÉÄß", "x9", "0", "naïve", "Ünï", "日本", "a" * 64, "b" * 65, "é" * 40, "c" * 300, "q"]
DOCS = [(i, " ".join(r.choice(LEXICON) for _ in range(r.randrange(60)))) for i in range(120)]
ODD = [(200, None), (201, ""), (202, "\x00\t--"), (None, "one two " * 30), (None, None), (203, "\x85word tail " * 15), (204, " ".join(f"w{i}" for i in range(40_000)))]
CASES = {"rows": (DOCS + ODD, [x for _, x in DOCS[:9]] + [None, ""]), "twice": (DOCS + DOCS[:30] + ODD, ["alpha beta"]), "no target": (DOCS, []), "empty": ([], ["alpha"]), "short": (ODD[:3], ["alpha"])}


@pytest.mark.parametrize("case", CASES)
def test_against_plain_code(spark, case):
    docs, target = CASES[case]
    df = spark.createDataFrame([(i, x, 1, 0.5, "k", 2) for i, x in docs], "doc_id long, text string, rank int, score double, bucket string, part int")
    got = resample.resample(df, spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target)


def test_batches_do_not_mix_documents():
    texts = [b"a b", b"", b"c", b"d e f", b"--", b"g"]
    doc, bucket = resample.features(texts)
    want = sorted((i, b) for i, t in enumerate(texts) for b in grams(t.decode()))
    assert sorted(zip(doc.tolist(), bucket.tolist(), strict=True)) == want


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_long_texts_come_in_pieces(size):
    texts = [x.encode() for _, x in DOCS[:20]] + [b"", b"-- --", b"a--b", b"-" * 30 + b"x" + b"-" * 30, b"Q" * 50, b"a -- " * 9]
    for text in texts:
        parts = list(resample.pieces(text, size))
        _, bucket = resample.features([t for t, _ in parts], [a for _, a in parts])
        assert sorted(bucket.tolist()) == sorted(grams(text.decode()))


def test_crc_of_joined_parts():
    a, b = [b"", b"x", b"hello", b"\xff" * 9], [b"y", b"world", b"z" * resample.SHORT, b"\x80\x81"]
    got = resample._joined(np.array([zlib.crc32(x) for x in a], np.uint32), np.array([zlib.crc32(x) for x in b], np.uint32), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]


def test_drawn_are_nearer_to_the_target(spark):
    like, unlike = "red green blue ", "one two three "
    df = spark.createDataFrame([(i, (like if i % 2 else unlike) * 10) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(0, like * 50)], "item_id long, text string")
    drawn = [x.doc_id for x in resample.take(df, target).collect()]
    assert len(drawn) == 100 and sum(i % 2 for i in drawn) > 90
