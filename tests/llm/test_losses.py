"""Transport streams with lost, repeated, scrambled and plain packets; vectors of extreme length."""

import numpy as np
import pytest
from test_methods import plain_ts

from metrikon.llm import hnsw, mpegts

P = 188
rng = np.random.default_rng(9)
UNIT = rng.integers(0, 256, 9000, dtype=np.uint8).tobytes()
UNITS = [(9000, UNIT, True), (12_000, UNIT[::-1], False)]


def stream():
    """One stream of two units without stated lengths, and the places of its packets."""
    s = plain_ts([(0x1E1, 0x1B, UNITS)])
    rows = [s[i : i + P] for i in range(0, len(s), P)]
    own = [i for i, r in enumerate(rows) if (r[1] & 31) << 8 | r[2] == 0x1E1]
    return rows, own


@pytest.mark.parametrize("n", [1, 14, 15, 17, 31])
def test_losses_in_an_unbounded_unit(n):
    rows, own = stream()
    gone = set(own[10 : 10 + n])
    d = mpegts.demux_bytes(b"".join(r for i, r in enumerate(rows) if i not in gone))
    assert d["broken"] == 1 and d["repeats"] == 0 and d["damaged"] == [0]
    assert len(d["payload"]) == 2 * len(UNIT) - 184 * n


def test_sixteen_lost_packets_show_in_bounded_units_only():
    rows, own = stream()
    d = mpegts.demux_bytes(b"".join(r for i, r in enumerate(rows) if i not in set(own[10:26])))
    assert d["broken"] == 0 and d["damaged"] == []  # the counter comes round
    s = mpegts.mux_bytes(bytes(range(256)) * 200)
    rows = [s[i : i + P] for i in range(0, len(s), P)]
    own = [i for i, r in enumerate(rows) if (r[1] & 31) << 8 | r[2] == mpegts.ES_PID]
    d = mpegts.demux_bytes(b"".join(r for i, r in enumerate(rows) if i not in set(own[18:34])))
    assert d["damaged"] != []


def test_repetitions_are_equal_and_come_once():
    rows, own = stream()
    k = own[5]
    twice = mpegts.demux_bytes(b"".join(rows[: k + 1] + rows[k:]))
    assert (twice["repeats"], twice["broken"], twice["damaged"], twice["payload"]) == (1, 0, [], UNIT + UNIT[::-1])
    thrice = mpegts.demux_bytes(b"".join(rows[: k + 1] + [rows[k]] + rows[k:]))
    assert (thrice["repeats"], thrice["broken"], thrice["damaged"]) == (1, 1, [0])
    other = bytearray(rows[k])
    other[100] ^= 1
    other = mpegts.demux_bytes(b"".join(rows[: k + 1] + [bytes(other)] + rows[k + 1 :]))
    assert (other["repeats"], other["broken"], other["damaged"]) == (0, 1, [0])


def test_a_repetition_may_have_another_clock():
    s = mpegts.mux_bytes(bytes(range(256)) * 40)
    rows = [bytearray(s[i : i + P]) for i in range(0, len(s), P)]
    k = next(i for i, r in enumerate(rows) if r[3] & 0x20 and r[4] >= 7 and r[5] & 0x10)
    again = bytearray(rows[k])
    again[8] ^= 0x55
    d = mpegts.demux_bytes(b"".join([*rows[: k + 1], again, *rows[k + 1 :]]))
    assert (d["repeats"], d["broken"], d["damaged"], d["payload"]) == (1, 0, [], bytes(range(256)) * 40)


@pytest.mark.parametrize(("kind", "want"), [(0xBC, 2008), (0xBE, 0), (0xBF, 2008), (0xF0, 2008), (0xF8, 2008), (0xFF, 2008), (0xE0, 2000)])
def test_stream_ids_without_a_header(kind, want):
    data = rng.integers(0, 128, 2000, dtype=np.uint8).tobytes()
    rest = data + b"\0" * 8 if kind != 0xE0 else b"\x80\x80\x05" + b"\x21\x00\x01\x00\x01" + data
    pes = bytes([0, 0, 1, kind]) + len(rest).to_bytes(2, "big") + rest
    pieces, tables = [pes[i : i + 184] for i in range(0, len(pes), 184)], mpegts.mux_bytes(b" ")[: 2 * P]
    out = []
    for k, piece in enumerate(pieces):
        head = bytes([0x47, (0x40 if k == 0 else 0) | mpegts.ES_PID >> 8, mpegts.ES_PID & 255])
        gap = 184 - len(piece)
        field = b"" if not gap else bytes([gap - 1]) + (b"\0" + b"\xff" * (gap - 2) if gap > 1 else b"")
        out.append(head + bytes([(0x30 if gap else 0x10) | k % 16]) + field + piece)
    d = mpegts.demux_bytes(tables + b"".join(out))
    assert len(d["payload"]) == want and d["errors"] == 0 and d["damaged"] == []
    assert d["pts"] == ([-1] if kind != 0xE0 else [mpegts.demux_bytes(tables + b"".join(out))["pts"][0]])


@pytest.mark.parametrize("at", [4, -1])
def test_scrambled_packets_are_left_out_and_marked(at):
    rows, own = stream()
    k = own[at]
    hidden = bytearray(rows[k])
    hidden[3] |= 0x80
    d = mpegts.demux_bytes(b"".join([*rows[:k], bytes(hidden), *rows[k + 1 :]]))
    assert d["scrambled"] == 1 and d["broken"] == 0 and d["damaged"] == ([0] if at == 4 else [1])
    assert len(d["payload"]) < 2 * len(UNIT) and mpegts.demux_bytes(b"".join(rows))["scrambled"] == 0


def test_vectors_of_extreme_length(spark):
    """Cosines do not depend on length: norms that would over- or underflow give the same neighbours and scores."""
    base = rng.normal(size=(60, 8))
    scale = np.array([[1.0, 2.0**600, 2.0**-600, 2.0**1000, 2.0**-1000][i % 5] for i in range(60)])
    frame = lambda v: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    find = lambda df: sorted(map(tuple, hnsw.search(hnsw.index(df), df.where("vec_id % 5 = 0 OR vec_id % 7 = 0")).collect()))
    plain, far = find(frame(base)), find(frame(base * scale[:, None]))
    assert plain == far and all(np.isfinite(r[3]) and abs(r[3]) <= 1 + 1e-9 for r in far)
    odd = [(0, [1e200, 1e200]), (1, [1e-200, 1e-200]), (2, [1e200, -1e200]), (3, [5e-324, 0.0]), (4, [1e308, 1e-308])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in hnsw.search(hnsw.index(df), df).collect()}
    assert got[0, 1] == pytest.approx(1) and got[0, 2] == pytest.approx(0, abs=1e-12) and got[3, 4] == pytest.approx(1) and len(got) == 20


@pytest.mark.parametrize(("n", "least"), [(4096, 0.97), (hnsw.MOST_ROWS, 0.95)])
def test_recall_of_the_largest_shard(n, least):
    """Random directions, the hardest case, at the least and the largest size of a shard."""
    r = np.random.default_rng(0)
    v = r.normal(size=(n, 64))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    q = r.choice(n, 100, replace=False)
    exact = v[q] @ v.T
    exact[np.arange(100), q] = -9
    top = np.argsort(-exact, axis=1)[:, :5]
    ids, _ = hnsw.build(v).search(v[q], hnsw.width(n))
    assert np.mean([len({*ids[i][ids[i] != q[i]][:5]} & {*top[i]}) / 5 for i in range(100)]) >= least


def test_recall_of_many_rows(spark):
    """More rows than a shard holds: shards' answers together."""
    r = np.random.default_rng(1)
    n = 2 * hnsw.MOST_ROWS + 500
    v = r.normal(size=(n, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>").repartition(8)
    asked = df.where("vec_id % 500 = 0")
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    got = {}
    for x in hnsw.search(hnsw.index(df), asked).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    hits = 0
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -9
        hits += len(found & {*np.argsort(-s)[:5].tolist()})
    assert len(got) == -(-n // 500) and hits / (5 * len(got)) >= 0.95
