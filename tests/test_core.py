"""Operators on small tables with answers worked out by hand or by brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrikon.functions import geometry, ids, nulls
from metrikon.operators import calibrate, compare, crossval, fuse, harmonize, horizon, mask, metrics, nearest, pseudonym, qc, ranks
from metrikon.plans import sites, tracks
from metrikon.sources import images, tables, workbook
from metrikon.streaming import flags


def one(df):
    return df.collect()[0].asDict()


def test_nulls(spark):
    df = spark.createDataFrame([(1.0, float("nan"), "2.5", "x"), (None, float("inf"), " 3 ", "")], "a double, b double, s string, t string")
    r = nulls.clean(df).select(nulls.row_mean("a", "b").alias("m"), nulls.number("s").alias("s"), nulls.number("t").alias("t"), "b").collect()
    assert [(x.m, x.s, x.t, x.b) for x in r] == [(1.0, 2.5, None, None), (None, 3.0, None, None)]


def test_ids(spark):
    df = spark.createDataFrame([("COST12a034",), ("ESCTC",), ("x_front_BACK.JPG",)], "s string")
    got = df.select(*(c.alias(k) for k, c in ids.parse_id(F.col("s")).items()), ids.view_of(F.col("s")).alias("v"), ids.subject_of(F.col("s")).alias("o")).collect()
    assert [tuple(x) for x in got] == [("CO", "ST", "034", None, None), ("ES", "CN", "", None, None), ("x_", "unknown", "", "front", "x")]


def test_pseudonyms(spark):
    df = spark.createDataFrame([("CO", "a", 1), ("CO", "b", 2)], "site string, ID string, v int")
    out = pseudonym.pseudonymise(df, "site", "ID", "s")
    assert out.columns == ["PSEUDO_ID", "site", "v"] and out.select("PSEUDO_ID").distinct().count() == 2
    assert pseudonym.collisions(pseudonym.mapping(df, "site", "site", "ID", "s", 0), "ID").count() == 1
    with pytest.raises(Exception, match="duplicate key"):
        pseudonym.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"]).collect()


def test_qc(spark):
    rows = [("A", str(i), float(i), 50.0) for i in range(1, 9)] + [("A", "x", 100.0, 500.0), ("A", "y", None, 60.0), ("B", "z", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "site string, id string, v double, AGE double")
    flagged = qc.flag(df, "site", ["v", "AGE"], {"v": (0.0, 90.0), "AGE": (0.0, 120.0)})
    got = {r.id: (r.QC_FLAGS, r.QC_COLUMNS, r.QC_N_FLAGS) for r in flagged.collect()}
    assert got["x"] == ("invalid_range;outlier", "AGE;v", 2) and got["y"] == ("missing_values", "v", 1) and got["1"] == ("", "", 0)
    count = lambda mode: {(r.site, r.column): (r.n_missing, r.n_invalid_range, r.n_outliers) for r in qc.report(flagged, "site", mode).collect()}
    assert count("cell_level")["A", "AGE"] == (0, 1, 0) and count("row_level")["A", "AGE"] == (0, 1, 1)
    assert {r.id for r in qc.flagged_values(flagged, "site", "id").collect()} == {"x", "y"}


def test_qc_without_or_with_repeated_ids(spark):
    """Rows without site or identifier and rows that repeat one count as rows."""
    rows = [(None, None, 1.0), (None, None, None), ("A", None, None), ("A", "1", 500.0), ("A", "1", 2.0)]
    flagged = qc.flag(spark.createDataFrame(rows, "site string, id string, v double"), "site", ["v"], {"v": (0.0, 90.0)})
    for mode in ("row_level", "cell_level"):
        assert {r.site: (r.n_rows, r.n_missing, r.n_invalid_range) for r in qc.report(flagged, "site", mode).collect()} == {None: (2, 1, 0), "A": (3, 1, 1)}
    assert sorted(map(str, [tuple(r) for r in qc.flagged_values(flagged, "site", "id").collect()])) == sorted(map(str, [(None, None, "v", None, "missing_values"), ("A", None, "v", None, "missing_values"), ("A", "1", "v", 500.0, "invalid_range")]))
    none = spark.createDataFrame([], "site string, id string, v double")
    assert qc.report(qc.flag(none, "site", ["v"]), "site").count() == 0


def test_ranges_are_inclusive(spark):
    assert len(qc.RANGES) == 25
    for c, (low, high) in qc.RANGES.items():
        df = spark.createDataFrame([(1, float(low)), (2, float(high)), (3, low - 0.01), (4, high + 0.01)], f"id int, `{c}` double").withColumn("site", F.lit("A"))
        bounds = spark.createDataFrame([], "site string, column string, low double, high double")
        assert {r.id for r in qc.flag(df, "site", [c], bounds=bounds).where("QC_FLAGS = 'invalid_range'").collect()} == {3, 4}


def test_metrics(spark):
    df = spark.createDataFrame([("front", 1.0, 2.0), ("back", 2.0, 2.0), (None, 5.0, 1.0), ("left", None, 1.0)], "view string, est double, truth double")
    m = {(r.grp, r.method): r for r in metrics.metric_matrix(df, {"e": "est"}, "truth", "view", {"FB": ["front", "back"]}).collect()}
    assert m["GLOBAL", "e"].n == 3 and m["FB", "e"].mae == 0.5 and ("left", "e") not in m
    e = df.withColumn("e", F.col("est") - F.col("truth"))
    assert one(metrics.error_metrics(e.where("view = 'left'"), "e", [], 0.0)) == {"n": 0, "bias": 0.0, "mae": 0.0, "rmse": 0.0}
    r = one(metrics.bland_altman(e.where("view = 'front'"), "e", ["view"]))
    assert r["low"] == r["high"] == -1.0
    assert one(metrics.with_r2(e.where("view = 'front'"), "truth", "est", ["view"]))["r2"] is None


def test_nearest(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, None), (3, 1.0)], "k int, fy double")
    refs = spark.createDataFrame([(1, 1, 8.0), (1, 0, 12.0), (2, 0, 1.0)], "k int, i int, y double")
    got = {r.k: r.i for r in nearest.nearest(rows, refs, "k", F.abs(F.col("fy") - F.col("y")), "i", ["i"]).collect()}
    assert got == {1: 0, 2: None, 3: None}
    s = {r.k: r for r in nearest.scale_summary(refs, ["k"], "y").collect()}
    assert s[1].scale == 10.0 and s[1].status == "low_confidence" and s[2].status == "ok" and s[2].cv is None


@pytest.mark.parametrize("n", [7, 8, 30])
def test_leave_one_out(spark, n):
    rng = np.random.default_rng(n)
    x, y = rng.normal(100, 10, n), rng.normal(50, 5, n)
    df = spark.createDataFrame([(i, "g", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(99, "g", None, 1.0), (98, "g", 3.0, None), (97, None, 3.0, 4.0)], "i int, g string, x double, y double")
    got = {r.i: r.corrected for r in calibrate.leave_one_out(df, "x", "y", ["g"]).collect()}
    assert [got[i] for i in (99, 98, 97)] == [None] * 3 and len(got) == n + 3
    assert {r.i for r in calibrate.leave_one_out(df, "x", "y", []).where("corrected IS NULL").collect()} == {98, 99}
    for j in range(n):
        keep = np.arange(n) != j
        want = np.polyval(np.polyfit(x[keep], y[keep], 1), x[j]) if n >= 8 else x[j]
        assert math.isclose(got[j], want, rel_tol=1e-9)


def test_loso(spark):
    rng = np.random.default_rng(0)
    rows = [(int(s), float(v)) for s, v in zip(rng.integers(0, 9, 200), rng.integers(0, 40, 200))] + [(50, None)]
    df = spark.createDataFrame(rows, "s int, v double")
    got = {r.s: r.loso for r in horizon.loso_median(df, df, "s", "v").collect()}
    for s in got:
        assert got[s] == np.median([v for t, v in rows if t != s and v is not None])
    alone = spark.createDataFrame([(1, 2.0)], "s int, v double")
    assert one(horizon.loso_median(alone, alone, "s", "v"))["loso"] is None


def test_loso_kinds_and_hot_subject(spark):
    """Two kinds of donor in one pass, a subject with most of the rows, a value that most rows have."""
    rng = np.random.default_rng(1)
    rows = [(k, 1 if rng.random() < 0.6 else int(rng.integers(2, 30)), 7.0 if rng.random() < 0.4 else float(rng.integers(0, 1000))) for k in ("a", "b") for _ in range(700)] + [("c", 1, 5.0)]
    df = spark.createDataFrame(rows, "kind string, s int, v double")
    got = {(r.kind, r.s): r.loso for r in horizon.loso_medians(df, df, "s", "v", "kind").collect()}
    subjects = {t for _, t, _ in rows}
    assert len(got) == 3 * len(subjects)
    for (k, s), m in got.items():
        rest = [v for q, t, v in rows if q == k and t != s]
        assert m == (np.median(rest) if rest else None)


def test_heights(spark):
    df = spark.createDataFrame([(100.0, 200.0, 50.0, 150.0), (100.0, 200.0, 50.0, 200.0), (100.0, 100.0, 50.0, 150.0)], "cam double, feet double, head double, hor double")
    c = F.col
    got = df.select(*(geometry.height(c("cam"), c("feet"), c("head"), c("hor"), v).alias(v) for v in "abc")).collect()
    assert [tuple(r) for r in got] == [(300.0, 300.0, 300.0), (None, None, None), (-100.0, -100.0, None)]


def test_hierarchy_keeps_value_and_label(spark):
    rows = [(1, "front", 10.0, "ok", 170.0), (1, "left", None, "ok", None), (2, "left", 5.0, "ok", 170.0), (2, "front", None, "no_cube", None), (3, "top", None, "ok", None), (4, "right", 6.0, "ok", 300.0), (4, "back", 4.0, "no_cube", 170.0), (4, "left", float("nan"), "ok", 170.0)]
    df = spark.createDataFrame(rows, "s int, view string, y double, status string, h double")
    got = {(r.s, r.view): (r.y_horizon_corrected, r.horizon_corrected_source, r.height_reliability) for r in horizon.correct(df, "s", "view", "y", "status", "h").collect()}
    assert got[1, "front"] == (10.0, "subject_front_back", "high") and got[2, "front"] == (10.0, "global_front_back_fallback_loo", "low")
    assert got[1, "left"] == (10.0, "subject_front_back_lateral_fallback", "medium") and got[3, "top"] == (10.0, "shared_unknown_view_fallback", "low")
    assert got[2, "left"] == (5.0, "per_image_cube_lateral", "high") and got[4, "right"] == got[4, "left"] == (10.0, "subject_front_back_lateral_fallback", "medium")
    alone = spark.createDataFrame(rows[2:5], df.schema)
    got = {(r.s, r.view): (r.y_horizon_corrected, r.horizon_corrected_source, r.y_horizon_shared, r.horizon_shared_source) for r in horizon.correct(alone, "s", "view", "y", "status", "h").collect()}
    assert got[2, "front"] == (None, "no_valid_horizon", None, "global_front_back_fallback_loo") and got[3, "top"][:2] == (5.0, "global_lateral_unknown_view_fallback_loo")


def test_moved_heads(spark):
    c = F.col
    df = spark.createDataFrame([("front", 100.0, 95.0), ("left", 100.0, 60.0), ("left", 100.0, 95.0), ("front", 100.0, 20.0), ("back", 100.0, None)], "view string, pose double, mask double")
    moved = geometry.corrected_head(c("view"), c("pose"), c("mask"), F.lit(500.0))
    assert [tuple(r) for r in df.select(*(v.alias(n) for n, v in moved.items())).collect()] == [(95.0, "mask_trim_hair", 5.0), (70.0, "mask_trim_hair_capped", 30.0), (95.0, "mask_trim_hair_capped", 5.0), (100.0, "pose", 0.0), (100.0, "pose", 0.0)]
    free = geometry.corrected_head(c("view"), c("pose"), c("mask"), F.lit(500.0), rise_px=None)
    assert [r[0] for r in df.select(free["head_y"]).collect()] == [95.0, 60.0, 95.0, 100.0, 100.0]


def test_fusion(spark):
    df = spark.createDataFrame([(1, "left", 2.0), (1, "right", 4.0), (2, "left", 3.0)], "s int, view string, v double")
    got = {r.s: r for r in fuse.subjects(df, "s", "view", "v").collect()}
    assert got[1].lr_diff == 2.0 and got[1].std == 1.0 and got[2].lr_diff is None and got[2].std == 0.0 and not got[2].has_right


def test_mask(spark):
    runs = [("a", y, 40, 42) for y in range(10)] + [("a", y, 30, 50) for y in range(10, 200)] + [("a", 200, 35, 37)]
    df = spark.createDataFrame(runs, "image_path string, y int, x0 int, x1 int")
    assert one(mask.feet(df))["feet_y"] == 200 and one(mask.head(df))["head_y"] == 10
    ankles = spark.createDataFrame([("a", "left", 40.0, 190.0, 21.0), ("a", "right", 45.0, 150.0, 21.0), ("a", "gone", 400.0, 190.0, 21.0)], "image_path string, ankle string, x double, y double, bbox_w double")
    got = {r.ankle: (r.contact_x, r.contact_y) for r in mask.contact(df, ankles).collect()}
    assert got == {"left": (40, 200), "right": (40, 166)}  # 8 % of 201 lines below the ankle at most
    views = mask.contact(df, ankles).selectExpr("*", "'Front' AS view")
    assert one(mask.support(views)) == {"image_path": "a", "feet_x": 40, "feet_y": 183, "source": "pose_midfeet"}
    assert one(mask.support(views.withColumn("view", F.lit("left"))))["feet_y"] == 200
    flat = spark.createDataFrame([("b", 5, 1, 9)], "image_path string, y int, x0 int, x1 int")
    both = {r.image_path: r.asDict() for r in mask.head_and_feet(df.union(flat)).collect()}
    assert both["b"]["status"] == "invalid_height_px" and both["b"]["head_x"] is None and both["b"]["area"] == 9
    assert both["a"] == {"image_path": "a", "head_x": 41, "head_y": 0, "feet_x": 40, "feet_y": 200, "height_px": 200.0, "area": 30 + 190 * 21 + 3, "status": "ok"}
    many = spark.createDataFrame([(k % 3, k % 11, k % 17) for k in range(60)], "k int, x0 int, n int").selectExpr("k", "x0", "x0 + n AS x1")
    pixels = {}
    for r in many.collect():
        pixels.setdefault(r.k, []).extend(range(r.x0, r.x1 + 1))
    assert {r.k: (r.m, r.pixels) for r in mask.pixel_median(many, ["k"], "m").collect()} == {k: (float(np.median(v)), len(v)) for k, v in pixels.items()}


def test_skeletal_and_manifest(spark):
    point = lambda x, y, c=0.9: {"x": float(x), "y": float(y), "conf": c}
    chain = [point(0, 0), point(3, 4), point(3, 8, 0.5), point(3, 9)]
    rows = [(1, chain, [point(0, 0, 0.1)] * 4, 10.0), (2, chain[:3] + [point(0, 0, 0.2)], None, 10.0), (3, chain, chain, 0.0), (4, chain, chain, None), (5, chain, chain, 5.0)]
    kind = "array<struct<x:double,y:double,conf:double>>"
    got = {r.i: r for r in fuse.skeletal(spark.createDataFrame(rows, f"i int, l {kind}, r {kind}, tall double"), "l", "r", "tall").collect()}
    assert (got[1].pose_side, got[1].min_confidence, got[1].shoulder_hip_px, got[1].hip_knee_ratio, got[1].status) == ("left", 0.5, 5.0, 0.4, "ok")
    assert got[2].status == "incomplete_pose_chain" and got[2].shoulder_hip_px is None
    assert got[3].status == got[4].status == "invalid_body_height_px" and got[5].pose_side == "right"
    assets = spark.createDataFrame([("A1", "/in/x/A1_front.jpg"), ("B2", "/in/B2_left.png"), (None, "/in/y.png")], "subject_id string, image_path string")
    kept = tables.manifest(assets, spark.createDataFrame([(" A1 ",), (None,)], "subject_id string"), "/out")
    assert [tuple(r) for r in kept.collect()] == [("A1", "/in/x/A1_front.jpg", "/out/A1/A1_front.jpg")]


def test_folds_and_ridge(spark):
    f = crossval.folds(12, 5)
    assert sorted(np.bincount(f).tolist()) == [2, 2, 2, 3, 3]
    rng = np.random.default_rng(3)
    rows = [(f"s{i:02d}", *map(float, rng.normal(size=3)), None if i % 6 == 4 else float(rng.normal())) for i in range(17)]
    df = spark.createDataFrame(rows, "s string, a double, b double, y double, c double")
    got = {r.s: r for r in crossval.nested(df, "s", "y", ["a", "b", "c"], "b").collect()}
    want = plain_nested(np.array([[np.nan if v is None else v for v in (r[1], r[2], r[4])] for r in rows], float), np.array([r[3] for r in rows]))
    assert {s: r.cv_fold for s, r in got.items()} == {r.s: r.cv_fold for r in crossval.kfold(df.select("s"), "s").collect()}
    for r, w in zip(rows, want, strict=True):
        g = got[r[0]]
        assert (g.cv_fold, g.ridge_alpha) == w[:2] and np.allclose([g.mean_model, g.raw_model, g.ols_model, g.ridge_model], w[2:])
    assert crossval.median_alpha(spark.createDataFrame(list(got.values()))) == np.median([w[1] for w in want])
    c = {r.feature: r for r in crossval.coefficients(df, "s", "y", ["a", "b"], 0.0).collect()}
    want = np.linalg.lstsq(np.array([[r[1], r[2], 1] for r in rows]), np.array([r[3] for r in rows]), rcond=None)[0]
    assert np.allclose([c["a"].coefficient_original_units, c["b"].coefficient_original_units, c["a"].intercept_original_units], want)
    for n in (0, 1, 2, 3):
        few = crossval.nested(df.limit(n), "s", "y", ["a", "b", "c"]).collect()
        assert len(few) == n and all(r.ridge_alpha == (None if n == 1 else 1.0) for r in few if n < 3)


def plain_nested(x, y):
    """Folds, median fill, standardising and ridge, written out."""
    def fit(x, y, alpha):
        med = np.nanmedian(x, 0)
        x = np.where(np.isnan(x), med, x)
        mu, sd = x.mean(0), x.std(0)
        z = (x - mu) / np.where(sd == 0, 1, sd)
        coef = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
        return lambda q: (np.where(np.isnan(q), med, q) - mu) / np.where(sd == 0, 1, sd) @ coef + y.mean()

    outer, out = crossval.folds(len(y), 5), {}
    for f in range(5):
        tr, te = outer != f, np.flatnonzero(outer == f)
        inner = crossval.folds(int(tr.sum()), 4)
        score = [np.mean([np.abs(fit(x[tr][inner != g], y[tr][inner != g], a)(x[tr][inner == g]) - y[tr][inner == g]).mean() for g in range(4)]) for a in crossval.ALPHAS]
        alpha = crossval.ALPHAS[int(np.argmin(score))]
        ols, ridge = fit(x[tr][:, [1]], y[tr], 0.0), fit(x[tr], y[tr], alpha)
        for i in te:
            out[i] = (f, alpha, y[tr].mean(), x[i, 1], ols(x[[i]][:, [1]])[0], ridge(x[[i]])[0])
    return [out[i] for i in range(len(y))]


def test_compare(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "k int, v double"), spark.createDataFrame([(2, 3.0)], "k int, v double")
    assert compare.outer({"a": a, "b": b}, "k").count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        compare.outer({"a": a.union(a), "b": b}, "k").collect()
    assert compare.ids_first(a.withColumn("id", F.lit(1)), ["id", "gone"]).columns == ["id", "k", "v"]


def test_harmonise(spark):
    df = spark.createDataFrame([("p1", "1.8", "80", "3", None), ("p2", "0", "x", "1", "2")], "`ID ` string, h string, w string, l string, r string")
    spec = harmonize.Mapping({"ID": "ID", "HEIGHT_cm": "h", "WEIGHT_kg": "w"}, {"HEIGHT_cm": 100.0}, {"ARM": ("l", "r")})
    got = harmonize.equalise(df, spec, ["ID", "TYPE", "HEIGHT_cm", "WEIGHT_kg", "PONDERAL_INDEX_kg_m3", "ARM"]).collect()
    assert got[0].HEIGHT_cm == 180.0 and math.isclose(got[0].PONDERAL_INDEX_kg_m3, 80 / 1.8**3) and got[0].ARM == 3.0
    assert got[1].WEIGHT_kg is None and got[1].PONDERAL_INDEX_kg_m3 is None and got[1].ARM == 1.5


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text(",,GENERAL,\nID,TYPE, AGE ,H\na,ST,3,x\n")
    got = tables.two_row_header(spark, str(tmp_path / "t.csv"))
    assert got.columns == ["ID", "TYPE", "AGE", "H"] and [tuple(r) for r in got.collect()] == [("a", "ST", "3", "x")]
    assert tables.bands(spark, str(tmp_path / "t.csv")) == {"ID": "", "TYPE": "", "AGE": "GENERAL", "H": "GENERAL"}
    (tmp_path / "many").mkdir()
    (tmp_path / "many/a.csv").write_text(',,GENERAL,\nID,TYPE, AGE ,H\na,ST,3,"x, ""y""\nz"\n')
    (tmp_path / "many/b.csv").write_text(",,GENERAL,\nID,TYPE, AGE ,H\nb,,4,\n")
    assert sorted((tuple(r) for r in tables.two_row_header(spark, str(tmp_path / "many"), lines=False).collect()), key=str) == [("a", "ST", "3", 'x, "y"\nz'), ("b", None, "4", None)]
    for n in ("s1_front.jpg", "s1_left_markers.PNG", "readme.txt", "noview.jpg"):
        (tmp_path / n).write_bytes(b"x")
    assets = tables.image_assets(spark, str(tmp_path), "ES")
    assert sorted((r.subject_id, r.view, r.has_markers) for r in assets.collect()) == [("s1", "front", False), ("s1", "left", True)]
    assert tables.eligible(assets).count() == 1
    assert [r.view for r in tables.first_images(assets, 1).collect()] == ["front"] and tables.first_images(assets, 9).count() == 2
    with pytest.raises(FileNotFoundError, match="nothing"):
        tables.require(spark, [str(tmp_path), str(tmp_path / "nothing")])


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("A", str(i), float(i)) for i in range(10)] + [("A", "x", 999.0)], "site string, id string, v double")
    bounds = spark.createDataFrame([("A", "v", -10.0, 20.0)], "site string, column string, low double, high double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = flags.flag_stream(stream, "site", "id", ["v"], {}, bounds).writeStream.format("memory").queryName("flagged").start()
    q.processAllAvailable()
    q.stop()
    assert [r.id for r in spark.sql("SELECT id FROM flagged").collect()] == ["x"]


def test_sinks(spark, tmp_path):
    """Stores are replaced, by site in folders; an empty report keeps its header."""
    df = spark.createDataFrame([("A", 1), ("B", 2)], "site string, v int")
    for _ in range(2):
        tables.store(df, str(tmp_path / "t"), ["site"])
    assert sorted(p.name for p in (tmp_path / "t").glob("site=*")) == ["site=A", "site=B"] and spark.read.parquet(str(tmp_path / "t")).count() == 2
    tables.store(df.limit(1), str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 1
    for rows, lines in ((df, 3), (df.limit(0), 1)):
        tables.store_csv(rows, str(tmp_path / "c"))
        files = list((tmp_path / "c").glob("*.csv"))
        assert len(files) == 1 and len(files[0].read_text().splitlines()) == lines and files[0].read_text().startswith("site,v")


def test_paths_and_dictionary(spark):
    df = spark.createDataFrame([("file:///a//b/./c.jpg",), ("/a/x/y/../../b/c.jpg",), ("/a/b/c.jpg",), ("/",), (None,)], "p string")
    assert [r[0] for r in df.select(ids.normal_path(F.col("p"))).collect()] == ["/a/b/c.jpg"] * 3 + ["/", None]
    d = {r.column: r for r in sites.dictionary(spark).collect()}
    assert len(d) == 27 and d["AGE"].unit == "years" and d["PONDERAL_INDEX_kg_m3"].unit == "kg_m3" and d["LONG_Arm_AVG_cm"].averaged and d["PER_Hip_cm"].high == 175.0
    assert d["HEIGHT_cm"].sources == {"CO": ["HEIGHT_cm"], "BR": ["HEIGHT_cm"], "ES": ["Altura_m"]} and len(d["DIST_Thigh_AVG_cm"].sources["ES"]) == 2


def test_running_totals(spark):
    rng = np.random.default_rng(5)
    rows = [(int(v), int(w)) for v, w in zip(rng.integers(0, 50, 300), rng.integers(1, 9, 300), strict=True)]
    got = ranks.running(spark.createDataFrame(rows, "v int, w int"), ["v", "w"], "w").orderBy("v", "upto").collect()
    total = 0
    for (v, w), r in zip(sorted(rows), sorted(got, key=lambda r: (r.v, r.w, r.upto)), strict=True):
        total += w
        assert (r.v, r.w, r.upto) == (v, w, total)
    assert [r.upto for r in ranks.running(spark.createDataFrame([("b",), ("a",)], "k string"), ["k"]).orderBy("k").collect()] == [1, 2]


def test_experiment_1_edges(spark):
    """Images without calibration, marker, scale, references, feet or manual height."""
    im = spark.createDataFrame([(p, "CO", 7, "front", 100.0, s, h, 50.0, f) for p, s, h, f in (("a", "ok", 100.0, 10.0), ("b", "none", None, None), ("c", "ok", 50.0, 5.0), ("d", "ok", 1.0, 1.0), ("e", "ok_with_warning_x", 10.0, 2.0))], "image_path string, site string, subject_id int, view string, image_width double, landmark_status string, height_px double, feet_x_px double, feet_y_px double")
    cal = spark.createDataFrame([("a", 1, "ok", 0.5), ("a", 2, "ok", 9.0), ("b", 1, "low", 0.5), ("c", 1, "no_marker_detected", 0.5), ("d", 1, "ok", None), ("e", 1, "ok", 2.0)], "image_path string, row_order int, calibration_status string, scale_cm_per_pixel double")
    refs = spark.createDataFrame([("a", 0, 40.0, 12.0, 0.4, 0.5), ("a", 1, 60.0, 8.0, 0.6, 0.9), ("b", 0, 1.0, 1.0, 0.7, None)], "image_path string, reference_index int, center_x_px double, center_y_px double, reference_scale_cm_per_pixel double, detection_quality double")
    manual = spark.createDataFrame([("8", 100.0, 1)], "ID string, HEIGHT_cm double, row_order int")
    got = {r.image_path: r for r in tracks.experiment_1(im, cal, refs, manual).collect()}
    assert set(got) == {"a", "b", "e"} and got["b"].status == "landmark_failed_none" and got["e"].status == "ok" and got["a"].height_manual_cm is None and got["a"].error_cm_median_scale is None
    assert (got["a"].scale_median_all, got["a"].scale_best_quality, got["a"].closest_feet_reference_index, got["a"].ground_line_reference_index, got["a"].height_cm_best_quality_scale) == (0.5, 0.6, 0, 0, 60.0)
    assert got["b"].scale_best_quality is None and got["b"].scale_ground_line is None and got["e"].height_cm_median_scale == 20.0
    assert got["a"].perspective_flag and not got["e"].perspective_flag


def test_median_of_all(spark):
    for values in ([], [3.0], [1.0, 2.0], [5.0, 1.0, 1.0, 9.0], [2.0] * 7 + [8.0], [0.5, None, 4.0]):
        real = [v for v in values if v is not None]
        assert one(ranks.median(spark.createDataFrame([(v,) for v in values], "v double"), "v"))["median"] == (np.median(real) if real else None)
    df = spark.createDataFrame([(1, 2.0, True), (1, 9.0, False), (2, 4.0, True), (3, None, True), (None, 1.0, False)], "s int, v double, ok boolean")
    assert sorted((str(r.s), r.shared, r.shared_source) for r in horizon.shared(df, "s", "v", F.col("ok")).collect()) == [("1", 2.0, "subject"), ("1", 2.0, "subject"), ("2", 4.0, "subject"), ("3", 3.0, "global"), ("None", 3.0, "global")]


def workbook_bytes(sheets):
    """A small .xlsx: shared and inline strings, numbers, gaps."""
    import io
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    strings, out = [], io.BytesIO()

    def cell(ref, v, k):
        if v is None:
            return ""
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if k % 2:
            return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
        strings.append(v)
        return f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'

    with zipfile.ZipFile(out, "w") as z:
        for n, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{i}">' + "".join(cell(f"{chr(65 + j)}{i}", v, i) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
        links = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f"<workbook {main} {links}><sheets>" + "".join(f'<sheet name="{s}" sheetId="{n}" r:id="rId{n}"/>' for n, s in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{n}" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    clean = [["", None, "GENERAL", None], ["ID", "TYPE", " AGE ", None, "H m"], ["a", "ST", 3, None, 1.5], [None, None, None], ["b", None, 4.25]]
    (tmp_path / "w.xlsx").write_bytes(workbook_bytes({"Clean": clean, "Other": [["x"], ["1"]]}))
    (tmp_path / "note.txt").write_text("no workbook")
    rows = workbook.sheets(spark, str(tmp_path))
    assert {(r.sheet, r["count"]) for r in rows.groupBy("sheet").count().collect()} == {("Clean", 5), ("Other", 2)}
    t = workbook.table(rows, "Clean", 2)
    assert t.columns == ["ID", "TYPE", "AGE", "H m"] and sorted((tuple(r) for r in t.collect()), key=str) == [("a", "ST", "3", "1.5"), ("b", None, "4.25", None)]
    assert [tuple(r) for r in workbook.table(rows, "Other").collect()] == [("1",)]
    with pytest.raises(ValueError, match="Gone"):
        workbook.table(rows, "Gone")


def test_image_headers(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + bytes(9)
    jpeg = b"\xff\xd8\xff\xe0" + (16).to_bytes(2, "big") + bytes(14) + b"\xff\xff\xc2" + (17).to_bytes(2, "big") + b"\x08" + (300).to_bytes(2, "big") + (200).to_bytes(2, "big") + bytes(12)
    bmp = b"BM" + bytes(16) + (7).to_bytes(4, "little") + (-9).to_bytes(4, "little", signed=True) + bytes(20)
    for name, data in (("a.png", png), ("b.JPG", jpeg), ("c.bmp", bmp), ("d.png", png[:20]), ("e.jpg", b"\xff\xd8"), ("f.txt", png)):
        (tmp_path / name).write_bytes(data)
    got = {r.image_path.rsplit("/", 1)[1]: tuple(r)[1:] for r in images.dimensions(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("png", 640, 480), "b.JPG": ("jpeg", 200, 300), "c.bmp": ("bmp", 7, 9), "d.png": (None,) * 3, "e.jpg": (None,) * 3}


def test_skeletal_experiment(spark):
    """From images to coefficients: as many predictions as subjects with a height, better than the mean, null where there is nothing."""
    rng = np.random.default_rng(8)
    rows, manual = [], []
    for s in range(14):
        tall = float(rng.uniform(120, 180))
        for view in ("left", "right")[: 1 + (s % 5 > 0)]:
            px = 400 + float(rng.normal()) * 3
            chain = [(10.0, 100.0, 0.9), (10.0, 100 + px * 0.3, 0.9), (10.0, 100 + px * 0.55 + float(rng.normal()), 0.9), (10.0, 100 + px * 0.8, 0.9)]
            rows.append((f"/i/{s}_{view}.jpg", s, view, 500.0, px, chain, None, tall / px))
        manual.append((str(s), tall if s else None))
    rows.append(("/i/99_left.jpg", 99, "left", 500.0, 0.0, None, None, 0.4))
    kind = "array<struct<x:double,y:double,conf:double>>"
    im = spark.createDataFrame(rows, f"image_path string, subject_id int, view string, feet_y double, body_height_px double, left {kind}, right {kind}, s double")
    refs = im.where("subject_id < 7").selectExpr("image_path", "subject_id", "view", "490.0D AS center_y_px", "s AS reference_scale_cm_per_pixel", "0 AS reference_index")
    cal = im.where("subject_id >= 7").selectExpr("image_path", "subject_id", "view", "s AS scale_cm_per_pixel")
    out = tracks.skeletal(im.drop("s"), refs, cal, spark.createDataFrame(manual, "subject_id string, height_manual_cm double"))
    assert {r.scale_source for r in out["images"].select("scale_source").distinct().collect()} == {"closest_reference_to_feet", "image_calibration_scale"}
    predicted = out["predictions"].collect()
    assert sorted(int(r.subject_id) for r in predicted) == list(range(1, 14))
    m = {r.model: r for r in out["metrics"].collect()}
    assert m["raw_model"].mae < 1e-9 and m["ols_model"].mae < 1e-6 and m["ridge_model"].mae < m["mean_model"].mae and m["mean_model"].n == 13
    assert [r.feature for r in out["coefficients"].collect()] == tracks.FUSED
    spec = tracks.render_spec(spark.createDataFrame([("p", 170.25, None, 120.0, 168.0, 1.0, 2.0, None, 9.0)], "image_path string, h double, g double, y double, height_manual_cm double, head_x double, head_y double, feet_x double, feet_y double"), {"own": ("h", "y"), "other": ("g", None)}).collect()
    assert [(r.method, r.title, r.lines[0].y, [p.name for p in r.points]) for r in spec] == [("own", "own 170.3 cm (2.3)", 120.0, ["head"])] or spec[0].title in ("own 170.2 cm (2.2)",)


def test_largest_component(spark):
    """Against a flood over pixels, corners included."""
    rng = np.random.default_rng(6)
    runs, want = [], {}
    for k in range(25):
        grid = rng.random((12, 14)) < (0.35 if k else 0.9)
        grid[0, 0] = True
        mine = [(y, x) for y, x in zip(*np.nonzero(grid), strict=True)]
        part = {}
        for spot in mine:
            if spot not in part:
                part[spot], stack = spot, [spot]
                while stack:
                    y, x = stack.pop()
                    for n in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                        if n not in part and 0 <= n[0] < 12 and 0 <= n[1] < 14 and grid[n]:
                            part[n] = spot
                            stack.append(n)
        sizes = {}
        for spot, root in part.items():
            sizes[root] = sizes.get(root, 0) + 1
        best = min((r for r in sizes if sizes[r] == max(sizes.values())))
        want[f"i{k}"] = {s for s, r in part.items() if r == best}
        for y in range(12):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], grid[y].astype(int), [0]])))
            runs += [(f"i{k}", y, int(a), int(b) - 1) for a, b in edge.reshape(-1, 2)]
    runs += [("i0", 3, 0, 2), (None, 1, 1, 1)]  # a run twice over
    got = {}
    for r in mask.largest_component(spark.createDataFrame(runs, "image_path string, y int, x0 int, x1 int")).collect():
        got.setdefault(r.image_path, set()).update((r.y, x) for x in range(r.x0, r.x1 + 1))
    want["i0"] = want["i0"] | ({(3, 0), (3, 1), (3, 2)} if (3, 0) in got["i0"] else set())
    assert got == want
