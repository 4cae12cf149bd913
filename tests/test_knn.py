"""Nearest neighbours against plain loops over all pairs, row by row."""

import itertools
import math
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrikon.operators import knn
from metrikon.plans import tracks


def moments(values):
    v = [x for x in values if x is not None]
    m = sum(v) / len(v) if v else 0.0
    return m, math.sqrt(sum((x - m) ** 2 for x in v) / len(v)) if v else 0.0


def brute(rows, strata, key, columns, targets, k, hidden, used=lambda stratum: None):
    """(stratum, key, column, own, [donors' (distance, key, value)]) of every cell asked for, rows told by their place."""
    out = []
    for stratum in {tuple(r[s] for s in strata) for r in rows}:
        if None in stratum:
            continue
        own = [r for r in rows if tuple(r[s] for s in strata) == stratum]
        kept = used(stratum) or columns
        z = {c: [None if r[c] is None or not s else (r[c] - m) / s for r in own] for c in kept for m, s in [moments([r[c] for r in own])]}
        for t in targets:
            for i, r in enumerate(own):
                if (r[t] is None) == hidden:
                    continue
                found = []
                for j, o in enumerate(own):
                    terms = [(z[c][i] - z[c][j]) ** 2 for c in kept if (not hidden or c != t) and z[c][i] is not None and z[c][j] is not None]
                    if i != j and o[t] is not None and terms:
                        found.append((math.sqrt(len(kept) / len(terms) * sum(terms)), o[key] is not None, o[key] or 0, o[t]))
                if found:
                    out.append((stratum, r[key], t, r[t], sorted(found)[:k]))
    return out


COLUMNS, TARGETS = ["a", "b", "c", "d"], ["b", "c", "x"]
SCHEMA = "id int, g string, h int, a double, b double, c double, d double, x double"


def table(n, seed=1, missing=0.25, groups=("s", "t")):
    rng = np.random.default_rng(seed)
    value = lambda: None if rng.random() < missing else float(rng.normal())
    return [{"id": int(rng.integers(n)), "g": str(rng.choice(groups)), "h": 1, **{c: value() for c in (*COLUMNS, "x")}} for _ in range(n)]


ODD = [
    {"id": 1, "g": "s", "h": 1, "a": 0.1, "b": 50.0, "c": None, "d": None, "x": 1.0}, {"id": 1, "g": "s", "h": 1, "a": 0.15, "b": -50.0, "c": 1.0, "d": None, "x": None}, {"id": None, "g": "s", "h": 1, "a": 0.2, "b": 7.0, "c": 2.0, "d": 0.0, "x": 3.0},
    {"id": 5, "g": None, "h": 1, "a": 0.2, "b": 7.0, "c": None, "d": 0.0, "x": 3.0}, {"id": 6, "g": "u", "h": 1, "a": None, "b": None, "c": None, "d": None, "x": None}, {"id": 7, "g": "v", "h": 1, "a": 1.0, "b": None, "c": 1.0, "d": 1.0, "x": None},
]
CASES = {"rows": table(90) + ODD, "odd": ODD, "empty": [], "twice": table(40, 3) * 2, "sparse": table(60, 4, 0.6), "full": table(60, 5, 0.0)}


def rounded(v):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in v)


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


@pytest.mark.parametrize(("case", "block"), [("rows", 1024), ("rows", 8), ("rows", 3), ("odd", 2), ("empty", 8), ("twice", 8), ("sparse", 4), ("full", 4)])
def test_against_all_pairs(spark, case, block):
    rows = CASES[case]
    df = frame(spark, rows)
    got = sorted((rounded(r) for r in knn.impute(df, ["g", "h"], "id", COLUMNS, TARGETS, 3, block).select("g", "h", "id", "column", "value").collect()), key=str)
    want = [(*s, i, t, statistics.median(f[3] for f in found)) for s, i, t, _, found in brute(rows, ["g", "h"], "id", COLUMNS, TARGETS, 3, False)]
    assert got == sorted(map(rounded, want), key=str)
    detail = knn.lovo_detail(df, ["g", "h"], "id", COLUMNS, TARGETS, [1, 4], 3, block).select("g", "h", "id", "column", "k", "truth", "predicted", "used")
    tested = brute(rows, ["g", "h"], "id", COLUMNS, TARGETS, 4, True)
    many = {(s, t) for s, t in ((s, t) for s, _, t, _, _ in tested) if sum(r[t] is not None and (r["g"], r["h"]) == s for r in rows) >= 3}
    want = [(*s, i, t, k, own, statistics.median(f[3] for f in found[:k]), len(found[:k])) for s, i, t, own, found in tested if (s, t) in many for k in (1, 4)]
    assert sorted((rounded(r) for r in detail.collect()), key=str) == sorted(map(rounded, want), key=str)


def test_a_row_does_not_predict_itself_through_its_key(spark):
    rows = [(1, "s", 0.0, 50.0), (1, "s", 0.1, 60.0), (2, "s", 9.0, 1.0), (3, "s", 9.1, 2.0)]
    df = spark.createDataFrame(rows, "id int, g string, a double, b double")
    got = sorted((r.id, r.truth, r.predicted) for r in knn.lovo_detail(df, ["g"], "id", ["a", "b"], ["b"], [1]).collect())
    assert got == [(1, 50.0, 60.0), (1, 60.0, 50.0), (2, 1.0, 2.0), (3, 2.0, 1.0)]
    gaps = knn.numbered(spark.createDataFrame([(1, "s", 0.0, None), (1, "s", 9.0, None), (2, "s", 0.1, 5.0), (3, "s", 9.1, 7.0)], df.schema), "n")
    filled = knn.complete(gaps, knn.impute(gaps, ["g"], "id", ["a", "b"], ["b"], 1, row="n"), "n", ["b"])
    assert sorted((r.id, r.a, r.b, r.b_was_imputed, r.IMPUTED_COLUMNS, r.N_IMPUTED_VALUES) for r in filled.collect()) == [(1, 0.0, 5.0, True, "b", 1), (1, 9.0, 7.0, True, "b", 1), (2, 0.1, 5.0, False, "", 0), (3, 9.1, 7.0, False, "", 0)]


@pytest.mark.parametrize(("missing", "hidden"), [(0.0, False), (0.02, True)])
def test_far_blocks_are_skipped(spark, missing, hidden):
    """Measures that follow one size, as bodies' do, with some values missing: the same rows from a quarter of the pairs at most."""
    rng = np.random.default_rng(6)
    n, size = 5000, rng.normal(size=5000)
    data = size[:, None] + 0.05 * rng.normal(size=(n, 5))
    gone = rng.random((n, 5)) < missing
    rows = [(i, "s", *(None if gone[i, j] else float(data[i, j]) for j in range(5))) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, g string, a double, b double, c double, d double, x double")
    args = (["g"], "id", ["a", "b", "c", "d", "x"], ["b", "x"])
    search = knn._Search(df, *args, 3, hidden, 64, None, None, None)
    few = sorted((rounded(r) for r in knn._top(search).select("id", "column", "distance", "donor").collect()), key=str)
    pairs, every = search.compared().first()
    whole = knn._Search(df, *args, 3, hidden, 4096, None, None, None)
    assert few == sorted((rounded(r) for r in knn._top(whole).select("id", "column", "distance", "donor").collect()), key=str)
    assert every == n * n and (pairs or 0) < n * n / 4, (hidden, pairs)


def test_column_sets(spark):
    rng = np.random.default_rng(3)
    rows = []
    for site, kind in (("A", "x"), ("A", "y"), ("B", "x"), ("C", "z")):
        for _ in range(1 if site == "C" else 30):
            a, e = rng.normal(), rng.normal(size=3)
            a, e = float(a), e.tolist()
            rows.append((site, kind, a, a + (0.05 if kind == "x" else 3) * e[0], e[1] if site == "A" else None, 2 * a + 0.01 * e[2] if rng.random() < 0.8 else None, 1.0))
    df = spark.createDataFrame(rows, "site string, kind string, a double, b double, c double, d double, e double")
    columns = ["a", "b", "c", "d", "e"]
    got = {(r.site, r.kind): [c for c, u in zip(columns, r.used, strict=True) if u] for r in knn.column_sets(df, ["site", "kind"], columns, ["site"], 0.9).collect()}
    assert got == {("A", "x"): ["a", "c", "e"], ("A", "y"): ["a", "b", "c", "e"], ("B", "x"): ["a", "e"], ("C", "z"): [c for c in columns if c != "c" and df.where("site = 'C'").first()[c] is not None]}
    assert knn.not_redundant(df.where("kind = 'y'"), columns) == ["a", "b", "c", "e"]
    assert knn.not_redundant(df.limit(0), columns) == columns


@pytest.mark.parametrize("mode", ["all", "corr"])
def test_reduced_columns_and_targets_outside_them(spark, mode):
    """Mode corr: the columns are those of each stratum, and a target that is not among them has nothing to hide."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(70):
        a = float(rng.normal())
        near = i % 2 == 0
        rows.append({"id": i, "g": "s" if near else "t", "h": i % 3, "a": a, "b": a + float(rng.normal()) * (0.01 if near else 2), "c": None if rng.random() < 0.3 else float(rng.normal()), "d": float(rng.normal()), "x": None if rng.random() < 0.2 else a * 3})
    strata, limit = ["g"], 0.9 if mode == "corr" else None

    def used(stratum):
        own = [r for r in rows if (r["g"],) == stratum]
        kept = []
        for c in COLUMNS:
            r = [np.corrcoef(*np.array([(o[c], o[k]) for o in own if o[c] is not None and o[k] is not None]).T)[0, 1] for k in kept]
            if limit is None or not any(abs(v) > limit for v in r):
                kept.append(c)
        return kept

    assert (used(("s",)) == ["a", "c", "d"]) == (mode == "corr") and used(("t",)) == COLUMNS
    got = knn.lovo_detail(frame(spark, rows), strata, "id", COLUMNS, TARGETS, [3], 3, 16, ["g"], limit).select("g", "id", "column", "predicted").collect()
    want = [(*s, i, t, statistics.median(f[3] for f in found)) for s, i, t, _, found in brute(rows, strata, "id", COLUMNS, TARGETS, 3, True, used)]
    assert sorted(map(rounded, got)) == sorted(map(rounded, want))


def test_imputation_track(spark):
    rows = [("A", "ST", str(i % 8), 100.0 + i, 20.0 + i, 3.0 * i if i % 4 else None, 4.0 if i % 5 else None) for i in range(12)] + [("B", "ST", "z", 120.0, None, None, 1.0)]
    df = spark.createDataFrame(rows, "site string, TYPE string, ID string, HEIGHT_cm double, WEIGHT_kg double, p double, q double")
    out = tracks.imputation(df, "ID", ["HEIGHT_cm", "WEIGHT_kg", "p", "q"], mode="corr", k=1)
    by = {(r.site, r.feature_mode, r.k): r for r in out["by_group"].collect()}
    assert {k[0] for k in by} == {"A"} and by["A", "all", 1].n_tested == 9 + 9
    assert sum(r.best for r in out["summary"].collect()) == 1
    whole = out["complete"].collect()
    assert len(whole) == 13 and sum(r.N_IMPUTED_VALUES for r in whole) == 3 + 3
    assert all(r.n_neighbors_used == 1 and r.abs_error == round(abs(r.predicted_value - r.true_value), 3) for r in out["detail"].collect())


def test_distances_of_rows_that_share_a_key(spark):
    df = spark.createDataFrame([(1, "s", 0.0, 1.0), (1, "s", 3.0, None), (2, "s", 3.0, 1.0)], "id int, g string, a double, b double")
    got = knn.nan_distance(df, ["g"], "id", ["a", "b"])
    assert got.count() == 6 and got.where("id = 1 AND donor = 1").count() == 2
    assert got.where(F.col("distance").isNull()).count() == 0


@pytest.mark.parametrize("tile", [4, 2048])
def test_the_whole_matrix_of_a_hot_stratum_is_many_tasks(spark, tile):
    rows = [{**r, "g": None if i % 40 == 0 else "t" if i % 10 == 0 else "s"} for i, r in enumerate(table(80, 9))]
    got = knn.nan_distance(frame(spark, rows), ["g", "h"], "id", COLUMNS, tile).withColumn("task", F.spark_partition_id()).collect()
    own = {s: [r for r in rows if r["g"] == s] for s in ("s", "t")}
    want = []
    for s, part in own.items():
        z = [[None if r[c] is None else (r[c] - m) / d for r in part] for c in COLUMNS for m, d in [moments([r[c] for r in part])]]
        for i, j in itertools.permutations(range(len(part)), 2):
            terms = [(v[i] - v[j]) ** 2 for v in z if v[i] is not None and v[j] is not None]
            want.append((s, 1, part[i]["id"], part[j]["id"], math.sqrt(len(COLUMNS) / len(terms) * sum(terms)) if terms else None))
    assert sorted((rounded(tuple(r)[:-1]) for r in got), key=str) == sorted(map(rounded, want), key=str)
    share = max(Counter(r["task"] for r in got).values()) / len(got)
    assert tile == 2048 or share < 0.2


def test_the_whole_matrix_of_no_rows(spark):
    assert knn.nan_distance(frame(spark, []), ["g"], "id", COLUMNS).count() == 0


def test_a_row_of_the_whole_matrix_is_sent_no_more_often_as_the_table_grows(spark, monkeypatch):
    sent, kind = [], type(spark.range(1))
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *by: sent.append(self.count()) or plain(self, *by))
    often = []
    for n in (200, 800):
        sent.clear()
        got = knn.nan_distance(frame(spark, table(n, 2, groups=("s",))), ["g", "h"], "id", COLUMNS, 4)
        often.append(sum(sent) / n)
        assert got.count() == n * (n - 1)
    assert often[1] <= often[0] * 1.1, often


def test_columns_in_several_words(spark, monkeypatch):
    df = frame(spark, table(30, 7, 0.5))
    rows = lambda: sorted((rounded(r) for r in knn.nan_distance(df, ["g", "h"], "id", COLUMNS).collect()), key=str)
    want = rows()
    monkeypatch.setattr(knn, "WORD", 3)
    assert rows() == want and any(r[-1] is None for r in want)
