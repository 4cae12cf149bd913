"""Every document operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from metrikon.llm import bpe, compaction, mixing, mpegts, pfor, pii, quality, simhash, substring
from metrikon.llm.queries import PII_KEY, vocabulary

random.seed(5)
WORDS = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "12", "x_y"]
LONG = " ".join(random.choice(WORDS) + str(i % 997) for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, None, None), (2, "", "a"), (3, "  \t\n ", "a"), (4, "one", "b"), (5, "the quick brown fox", "b"), (6, "the quick brown fox", "b"), (7, LONG, "a"), (8, LONG + " tail", "a"),
    (9, "start " + PASSAGE + " end", "c"), (10, PASSAGE + " " + PASSAGE, None), (11, "mail to jo.12@mail3.example.com or +1 (212) 555-0199 <|endoftext|> ΑΣ ſ", "c"), (12, "a\x85b c \x1c d²", "c"),
]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, block int, key string, fp long, _copies int, copies int, media string, score double, ids string, _arrival int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", None, 1, "k", 2, 3, 4, None, 0.5, None, 9) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module", params=["rows", "empty", "twice"])
def docs(request, spark):
    return {"rows": ROWS, "empty": [], "twice": ROWS + ROWS[3:6]}[request.param], frame(spark, {"rows": ROWS, "empty": [], "twice": ROWS + ROWS[3:6]}[request.param])


def test_transport_stream(docs):
    rows, df = docs
    got = sorted(map(tuple, mpegts.digest(df).drop("media_bytes", "media_sha256", "feature", "pts", "random_access").collect()))
    want = []
    for i, t, _ in rows:
        n, p = mpegts.padded(t)
        want.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert got == sorted(want)
    back = mpegts.demux(mpegts.mux(df)).collect()
    assert sorted(r.payload for r in back) == sorted(mpegts.padded(t)[1] for _, t, _ in rows)
    assert all(r.broken == r.errors == 0 for r in back)


def test_substring(docs):
    rows, df = docs
    assert sorted(map(tuple, substring.digest(df).collect())) == sorted(substring.brute([(i, t) for i, t, _ in rows]))


def test_bpe(docs):
    rows, df = docs
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = {r.doc_id: r for r in bpe.encode_documents(df, vocabulary("word_bpe_49k.json")).collect()}
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert got[i].decoded == lib.decode(ids, skip_special_tokens=False)


def test_quality(docs, spark):
    rows, df = docs
    for labels in ([], [(4, 1), (5, 0), (7, None), (None, 1)]):
        got = quality.classify(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_compaction(docs):
    rows, df = docs
    store, back = compaction.compacted(df, smallest=2000, target_bytes=100_000)
    key = lambda r: tuple(map(str, r))
    assert sorted(back.collect(), key=key) == sorted(df.collect(), key=key)
    assert back.columns == df.columns


def test_pfor(docs):
    rows, df = docs
    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in pfor.digest(df, vocabulary("byte_bpe_50k.json")).collect())
    want, at = [], 0
    for i, t in sorted((i, t or "") for i, t, _ in rows):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_mixing(docs):
    rows, df = docs
    got = mixing.digest(df).collect()
    assert len(got) == len(rows)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    if rows and len({r[0] for r in rows}) == len(rows):
        assert mixed.count() == sum(r.copies for r in got if r.doc_id is not None)
        assert {r.doc_id: r.n_tokens for r in got} == {i: len((t or "").encode().split()) for i, t, _ in rows}


def test_simhash(docs):
    rows, df = docs
    got = sorted(map(tuple, simhash.digest(df).collect()))
    f = {i: brute_fingerprint(t) for i, t, _ in rows}
    root = {i: i for i in f}
    for _ in f:
        for i in f:
            root[i] = min(root[j] for j in f if (f[i] ^ f[j]).bit_count() <= 4)
    assert got == sorted((i, f"{f[i]:016x}", root[i]) for i, _, _ in rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


def brute_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_pii(docs):
    rows, df = docs
    got = {r.doc_id: r for r in pii.digest(df, PII_KEY).collect()}
    for i, t, _ in rows:
        if i != 11:
            assert got[i].text == (t or "") and got[i].n_entities == 0
        else:
            assert "jo.12@mail3" not in got[i].text and "555-0199" not in got[i].text and got[i].text.startswith("mail to ") and got[i].text.endswith("<|endoftext|> ΑΣ ſ")
    out = pii.pseudonymise(df, PII_KEY)
    assert out.columns == df.columns and out.count() == len(rows)


def test_temperature():
    tokens = [1000, 100, 10]
    a = mixing.temperature(tokens, sum(tokens), 0.9, None)
    shares = [t / sum(tokens) for t in tokens]
    assert abs(mixing.entropy(mixing.weights(shares, a)) - 0.9 * math.log(3)) < 1e-9
    a = mixing.temperature(tokens, sum(tokens), 0.99, 2.0)
    w = mixing.weights(shares, a)
    assert max(x / s for x, s in zip(w, shares, strict=True)) <= 2.0 + 1e-9


def test_mix_meets_budget(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 50)), "big" if i % 10 else "small") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(df, block_tokens=2000).collect()
    total = sum(r.n_tokens for r in got)
    for s in ("big", "small"):
        part = [r for r in got if r.source == s]
        assert abs(sum(r.n_tokens * r.copies for r in part) / total - part[0].weight) < 0.02
        assert max(r.copies for r in part) - min(r.copies for r in part) <= 1


def test_many_sources_stay_in_a_table(spark):
    """The weights are the same whether the shares come to the driver or not."""
    rows = [(i, " ".join(["w"] * (1 + i % 9)), None if i % 40 == 7 else f"s{int(i**0.5)}") for i in range(900)] + [(2000, "", "void")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    both = [sorted(map(str, mixing.plan(df, most_sources=n).select("doc_id", "copies", "block", "place", mixing.F.round("weight", 12)).collect())) for n in (1000, 3)]
    assert both[0] == both[1] and mixing.plan(df.limit(0), most_sources=0).count() == 0


def test_mix_wordless_blocks(spark):
    """A source without words is dealt into blocks like any other."""
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'w w' ELSE '' END AS text", "CASE WHEN id % 3 = 0 THEN 's' ELSE 'void' END AS source")
    got = mixing.plan(df, block_tokens=100).where("source = 'void'").groupBy("block").count().collect()
    assert len(got) == 20 and sum(r[1] for r in got) == 2000 and max(r[1] for r in got) < 200


def test_fit_takes_one_row_of_a_doc_id(spark, monkeypatch):
    """Repeated rows of a labelled doc_id do not reach the driver one by one: the least text of each counts."""
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: seen.append((texts, labels)))
    docs = spark.range(4000).selectExpr("id % 2 + 2 AS doc_id", "CASE WHEN id < 9 THEN NULL ELSE concat('t', id % 2) END AS text")
    quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(2, 4)], "doc_id long, quality int"))
    learn = [i for i in (2, 3) if zlib.crc32(str(i).encode()) % 3 != 1]
    (texts, labels), = seen
    assert texts == [""] * len(learn) and sorted(labels) == sorted(i % 2 for i in learn)


def test_odd_ids_keep_their_texts(spark):
    """Rows without doc_id and two different texts under one doc_id are not lost."""
    a, b = (" ".join(f"{c}{i * i}" for i in range(40)) for c in "ab")
    df = frame(spark, [(None, a, "s"), (None, "x y", "s"), (None, None, None), (1, a, "s"), (1, b, "s"), (1, b, "s"), (2, a, "s"), (3, b, "t")])
    kept = simhash.keep_one(df)
    key = lambda r: tuple(map(str, r))
    want = [(None, None), (None, "x y"), (None, a), (1, a), (1, b)]
    assert kept.columns == df.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(want, key=key)
    many = {"budget": 3000, "most_repeats": None}
    planned = mixing.plan(df, **many).where("doc_id IS NULL").collect()
    mixed = mixing.mix(df, **many).where("doc_id IS NULL").collect()
    assert len(mixed) == sum(r.copies for r in planned) and {r.text for r in mixed} == {None, "x y", a}
