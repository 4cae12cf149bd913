"""The pipeline against a plain version on a small corpus; the mixing query against its SQL where sources are very unequal."""

import collections
import hashlib
import math
import random

import duckdb
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from metrikon.llm import mixing, pii, quality
from metrikon.llm.common import strings
from metrikon.llm.queries import PII_KEY, oracle_sql, queries, vocabulary

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=4):
    r = random.Random(seed)
    stock = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(400)]
    prose = lambda: ". ".join(" ".join(r.choices(stock, k=12)).capitalize() for _ in range(r.randint(3, 9))) + "."
    junk = lambda: " ".join(r.choice(["$$$", "win!!!", "CLICK", "00100", "||", "%%"]) for _ in range(60))
    rows = []
    for i in range(150):
        text = junk() if i % 5 == 0 else prose()
        if i % 7 == 3:
            text += f" Mail a.b{i}@mail{i % 3}.example.com or call +1 (212) 555-01{i % 100:02d}."
        rows.append((i, text, "en", "big" if i % 10 < 7 else None if i % 10 == 8 else "small", len(text)))
    rows += [(200 + k, rows[k][1], "de", "tiny", 1) for k in (1, 2, 3)] + [(210, None, None, "tiny", None), (211, "", "en", "big", 0), (212, rows[6][1] + " tail", "en", "big", 9)]
    return rows, [(i, int(i % 5 > 0), 0) for i in range(150)]


def fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def keep_one(rows):
    f = {r[0]: fingerprint(r[1]) for r in rows}
    root = {i: i for i in f}
    while (new := {i: min(root[j] for j in f if (f[i] ^ f[j]).bit_count() <= 4) for i in f}) != root:
        root = new
    return [r for r in rows if root[r[0]] == r[0]]


def mixed(rows):
    count = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    tokens = collections.Counter()
    for r in rows:
        tokens[r[3]] += count[r[0]]
    total = sum(tokens.values())
    alpha = mixing.temperature(list(tokens.values()), total, 0.97, 4.0)
    up = {s: (n / total) ** alpha for s, n in tokens.items() if n}
    out = []
    for s, n in tokens.items():
        passes, before = up.get(s, 0) / sum(up.values()) * total / n if n else 1.0, 0
        whole = math.floor(passes)
        for _, r in sorted((hashlib.md5(f"mix|{r[0]}".encode()).hexdigest(), r) for r in rows if r[3] == s):
            out += [r] * (whole + (before + count[r[0]] / 2 < (passes - whole) * n))
            before += count[r[0]]
    return out


def test_pipeline(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, marks = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    score = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, marks)).collect()}
    left = [r for r in rows if score[r[0]] >= 0.5]
    assert {r[0] for r in left} >= {i for i, y, _ in labels if y} and not {r[0] for r in left} & {i for i, y, _ in labels if not y}
    left = keep_one(left)
    assert not {201, 202, 203} & {r[0] for r in left}
    left = [(i, t and pii.replace(t, PII_KEY)[0], *rest) for i, t, *rest in left]
    left = mixed(left)
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = []
    for i, text, *_ in left:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), b"".join(x.to_bytes(4, "little") for x in ids), lib.decode(ids, skip_special_tokens=False)))
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Rows without doc_id, repeated rows, a null source and columns that operators could take for their own."""
    rows, labels = corpus(9)
    rows = rows[:60] + [rows[1]] * 3 + [(None, rows[2][1], "en", "big", 1), (None, rows[2][1], "en", None, 1), (None, None, None, None, None)]
    kind = DOCUMENTS + ", _fp string, _marks int, _copies string, block int, marks string"
    spark.createDataFrame([(*r, "f", 1, "c", 2, "m") for r in rows], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, marks = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    score = quality.fit(docs, marks)
    good = lambda t: score.score(*strings(pa.array([t or ""])))[0] >= 0.5
    left = [r for r in rows if good(r[1])]
    with_id = keep_one(sorted({r for r in left if r[0] is not None}))
    want = sorted(str((i, t and pii.replace(t, PII_KEY)[0])) for i, t, *_ in with_id + [r for r in left if r[0] is None])
    out = docs
    for name, f in corpus_pipeline.STAGES[:3]:
        out = f(spark, out, str(tmp_path))
        assert out.columns == docs.columns, name
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == want
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {r[0] for r in left} and sum(r.doc_id is None for r in got) >= 2


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("sizes", [[4000, 60, 9], [900, 800, 700], [50_000, 1]])
def test_mixing_sql(spark, tmp_path, sizes):
    rows = [(s * 10_000 + i, " ".join(["w"] * (1 + i % 7)), "en", f"s{s}", 1) for s, n in enumerate(sizes) for i in range(max(1, n // 40))]
    rows = [(i, " ".join([t] * 40), *rest) for i, t, *rest in rows] + [(90_001, None, "en", "s0", 0), (90_002, " \t", "en", None, 0)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(oracle_sql()["op8_temperature_mix"]).fetchall()
    got = queries()["op8_temperature_mix"](spark, str(tmp_path)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key) and len(got) == len(rows)
