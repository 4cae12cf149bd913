"""Experiment 2 by hand, and cleaned masks against pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrikon.functions import geometry
from metrikon.operators import mask
from metrikon.plans import tracks


def pixels(runs, h, w):
    out = np.zeros((h, w), bool)
    for y, a, b in runs:
        out[y, a : b + 1] = True
    return out


def shifted(m, size, grow):
    """Dilation or erosion by a square, what is outside being neutral."""
    half, (h, w) = size // 2, m.shape
    wide = np.pad(m, half, constant_values=not grow)
    parts = [wide[i : i + h, j : j + w] for i in range(size) for j in range(size)]
    return np.any(parts, 0) if grow else np.all(parts, 0)


def largest(m):
    label, best = np.zeros(m.shape, int), (0, None)
    for y, x in zip(*np.nonzero(m), strict=True):
        if not label[y, x]:
            label[y, x], todo, own = 1, [(y, x)], []
            while todo:
                a, b = todo.pop()
                own.append((a, b))
                for i in range(max(a - 1, 0), min(a + 2, m.shape[0])):
                    for j in range(max(b - 1, 0), min(b + 2, m.shape[1])):
                        if m[i, j] and not label[i, j]:
                            label[i, j] = 1
                            todo.append((i, j))
            if len(own) > best[0]:
                best = (len(own), own)
    out = np.zeros(m.shape, bool)
    for a, b in best[1] or []:
        out[a, b] = True
    return out


def test_cleaned_masks(spark):
    r = np.random.default_rng(5)
    h, w, images = 40, 30, {}
    for k in range(12):
        runs = [(int(y), int(a := r.integers(0, w)), int(min(w - 1, a + r.integers(0, 12)))) for y in r.integers(0, h, 40 + 20 * (k % 4))]
        runs += [(y, 5, 20) for y in range(8, 30) if (k + y) % 9] + ([(y, 0, 6) for y in range(12)] if k % 2 else [])
        images[k] = runs
    images[12] = [(20, 15, 15)]  # too thin to stay
    df = spark.createDataFrame([(k, y, a, b, h, w) for k, runs in images.items() for y, a, b in runs], "image_path int, y int, x0 int, x1 int, img_h int, img_w int")
    got = {}
    for x in mask.cleaned(df).collect():
        got.setdefault(x.image_path, []).append((x.y, x.x0, x.x1))
    for k, runs in images.items():
        m = pixels(runs, h, w)
        m = shifted(shifted(m, 9, True), 9, False)
        m = shifted(shifted(m, 5, False), 5, True)
        want = largest(m)
        assert (pixels(got.get(k, []), h, w) == want).all() or (pixels(got[k], h, w).sum() == want.sum())
        assert (k != 12) or k not in got
    wide = {}
    for x in mask.dilate(df.drop("img_h", "img_w"), 3).collect():
        wide.setdefault(x.image_path, []).append((x.y + 1, x.x0 + 1, x.x1 + 1))
    for k, runs in images.items():
        assert (pixels(wide[k], h + 2, w + 2) == shifted(np.pad(pixels(runs, h, w), 1), 3, True)).all()


def test_upright_edge(spark):
    square = [(0.0, 0.0), (20.0, 1.0), (19.0, 21.0), (-1.0, 20.0)]
    flat = [(0.0, 0.0), (40.0, 0.0), (40.0, 5.0), (0.0, 5.0)]
    tiny = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rows = [(k, [{"x": x, "y": y} for x, y in c]) for k, c in enumerate((square, flat, tiny))]
    got = {r.k: r.e and (r.e.base_y, r.e.top_y) for r in spark.createDataFrame(rows, "k int, corners array<struct<x:double,y:double>>").select("k", geometry.upright_edge(F.col("corners")).alias("e")).collect()}
    assert got == {0: (21.0, 1.0), 1: (0.0, 0.0), 2: None}  # of a flat marker only level sides are long enough


def marker(path, i, x, y, side):
    return (path, i, [{"x": x, "y": y}, {"x": x + side, "y": y}, {"x": x + side, "y": y + side}, {"x": x, "y": y + side}])


@pytest.fixture(scope="module")
def second(spark):
    images = [("a", "CO", "7", "front", 1000, "ok", 900.0, 200.0), ("b", "CO", "7", "left", 1000, "ok_with_warning_x", 880.0, 210.0), ("c", "CO", "8", "back", 0, "ok", 900.0, 200.0), ("d", "CO", "8", "right", 1000, "none", None, None), ("e", "CO", "9", "back", 1000, "ok", 900.0, 890.0), ("f", "CO", None, "front", 1000, "ok", 900.0, 200.0)]
    im = spark.createDataFrame(images, "image_path string, site string, subject_id string, view string, img_h int, landmark_status string, feet_y double, head_y double")
    runs = spark.createDataFrame([("b", y, 100, 180) for y in range(170, 891)] + [("a", y, 100, 180) for y in range(150, 871)], "image_path string, y int, x0 int, x1 int")
    # sides of 40 pixels at 10 cm: the horizon of a camera at 100 cm is 400 pixels above the base
    markers = spark.createDataFrame([marker("a", 1, 0.0, 860.0, 40.0), marker("a", 2, 0.0, 300.0, 40.0), marker("b", 1, 0.0, 840.0, 40.0), marker("c", 1, 0.0, 0.0, 4.0), marker("e", 1, 0.0, 860.0, 40.0)], "image_path string, marker_index int, corners array<struct<x:double,y:double>>")
    manual = spark.createDataFrame([("7", 170.0, 1), ("7", 1.0, 2), ("9", 100.0, 1)], "ID string, HEIGHT_cm double, row_order int")
    return tracks.experiment_2(im, runs, markers, manual)


def test_experiment_2(second):
    got = {r.image_path: r for r in second["estimates"].collect()}
    a, b = got["a"], got["b"]
    assert (a.status, a.y_horizon_cube, a.feet_source, a.head_source, a.y_head, a.head_move_px) == ("ok", 500.0, "pose", "mask_trim_hair", 150.0, 50.0)
    assert a.H_horizon_cube == 100 * 750 / 400 and a.error_horizon_cube == a.H_horizon_cube - 170 and (a.y_horizon_ref, a.horizon_ref_source, a.delta_horizon_px) == (500.0, "subject", 0.0)
    # lateral: the sole of the mask, and a head that rises 30 pixels at most
    assert (b.feet_source, b.y_feet, b.y_feet_single, b.y_feet_mask, b.head_source, b.y_head) == ("mask_bottom", 890.0, 880.0, 890.0, "mask_trim_hair_capped", 180.0)
    assert (b.y_horizon_cube, b.y_horizon_ref, b.delta_horizon_px, b.delta_horizon_frac) == (480.0, 500.0, -20.0, -0.02)
    assert b.H_horizon_shared == b.H_shared_feet_mask == 100 * 710 / 390 and b.H_shared_feet_single == 100 * 700 / 380
    assert (got["c"].status, got["c"].y_horizon_cube, got["c"].delta_horizon_frac, got["c"].horizon_ref_source, got["c"].y_horizon_ref) == ("no_cube_edge", None, None, "global", 500.0)
    assert (got["d"].status, got["d"].y_feet, got["d"].H_horizon_shared, got["d"].head_source) == ("person_failed_none", None, None, "pose")
    assert got["e"].status == "horizon_out_of_range" and got["e"].H_horizon_cube == 2.5 and got["f"].status == "no_aruco"
    assert got["c"].error_horizon_shared is None and got["f"].y_horizon_ref == 500.0


def test_experiment_2_summaries(second):
    align = {r.view: r for r in second["alignment"].collect()}
    assert (align["left"].n, align["left"].median_px, align["left"].std_px) == (1, -20.0, None) and align["back"].n == 1
    assert {r.subject_id: (r.front, r.left) for r in second["pivot"].collect()}["7"] == (0.0, -20.0)
    summary = {r.grupo: (r.n, r.mae_cm) for r in second["summary"].collect()}
    assert set(summary) == {"front", "back", "left", "right", "FRONT+BACK", "GLOBAL"} and summary["right"] == (0, 0.0) and summary["GLOBAL"][0] == 3
    assert {(r.grp, r.method) for r in second["matrix"].collect()} >= {("GLOBAL", "cube"), ("FRONT+BACK", "shared"), ("left", "feet_mask")}


def test_experiment_2_feeds_the_comparison(spark, second):
    """The final comparison takes the estimates as they are."""
    e1 = spark.createDataFrame([("a", "CO", "7", "front", 170.0, 2.0)], "image_path string, site string, subject_id string, view string, height_manual_cm double, error_cm_median_scale double")
    hzc = spark.createDataFrame([("b", 160.0, -10.0, "x", "high")], "image_path string, H_horizon_corrected double, error_horizon_corrected double, horizon_corrected_source string, height_reliability string")
    out = tracks.compare_methods(e1, second["estimates"], hzc)
    wide = {r.image_path: r for r in out["wide"].collect()}
    a = wide["a"]
    assert len(wide) == 6 and a.hz_err_shared == a.hz_err_cube == 17.5 and a.e1_err_median == 2.0 and a.hz_scale_shared_cmpx == 187.5 / 750
    assert {(r.grp, r.method): r.n for r in out["matrix"].collect()}["GLOBAL", "HZ compartido"] == 3


def test_experiment_2_without_images(spark):
    none = tracks.experiment_2(
        spark.createDataFrame([], "image_path string, site string, subject_id string, view string, img_h int, landmark_status string, feet_y double, head_y double"), spark.createDataFrame([], "image_path string, y int, x0 int, x1 int"),
        spark.createDataFrame([], "image_path string, marker_index int, corners array<struct<x:double,y:double>>"), spark.createDataFrame([], "ID string, HEIGHT_cm double, row_order int"),
    )
    assert none["estimates"].count() == none["alignment"].count() == 0
    assert sorted((r.grupo, r.n, r.mae_cm) for r in none["summary"].collect()) == [("FRONT+BACK", 0, 0.0), ("GLOBAL", 0, 0.0)]


def test_lateral_diagnostic(spark):
    """Own against shared horizon: only lateral views that are ok, both heights by hand, nulls where a side is missing."""
    rows = [("7", "Left", "ok", 100.0, 900.0, 500.0, 480.0, 170.0), ("7", "right", "ok", 100.0, 900.0, 520.0, 480.0, 170.0), ("8", "left", "ok", 100.0, 900.0, 950.0, 500.0, 210.0), ("9", "left", "no_aruco", 100.0, 900.0, 500.0, 500.0, 150.0), ("9", "front", "ok", 100.0, 900.0, 500.0, 500.0, 150.0), ("5", "right", "ok", 100.0, 900.0, 500.0, 500.0, None)]
    df = spark.createDataFrame(rows, "subject_id string, view string, status string, y_head double, y_feet double, y_horizon_cube double, y_horizon_ref double, height_manual_cm double")
    out = tracks.lateral_diagnostic(df)
    got = {(r.subject_id, r.view): r for r in out["predictions"].collect()}
    assert set(got) == {("7", "left"), ("7", "right"), ("8", "left"), ("5", "right")}
    a = got["7", "left"]
    assert a.pred_per_image_horizon_cm == 200.0 and a.pred_shared_horizon_cm == pytest.approx(100 * 800 / 420) and a.improvement_per_image_vs_shared_cm == pytest.approx(100 * 800 / 420 - 200) and a.horizon_delta_px == 20.0
    assert got["8", "left"].pred_per_image_horizon_cm is None and got["5", "right"].error_shared_horizon_cm is None  # the horizon lies below the feet
    views = {(r.group, r.method): r for r in out["views"].collect()}
    assert len(views) == 6 and (views["LATERAL_GLOBAL", "per_image_cube_horizon"].n, views["LATERAL_GLOBAL", "per_image_cube_horizon"].n_subjects) == (2, 3)
    assert views["right", "shared_subject_horizon"].n == 1 and views["right", "shared_subject_horizon"].r2 is None
    subjects = {r.subject_id: r for r in out["subjects"].collect()}
    assert set(subjects) == {"7", "8"} and subjects["7"].has_left and subjects["7"].has_right and not subjects["8"].has_right
    assert subjects["7"].left_right_prediction_difference_cm == pytest.approx(100 * 800 / 380 - 200) and subjects["8"].left_right_prediction_difference_cm is None
    assert {r.method: r.n for r in out["subject_summary"].collect()}["shared_horizon_left_right_mean"] == 2
    horizons = {r.group: r for r in out["horizons"].collect()}
    assert (horizons["LATERAL_GLOBAL"].n_images, horizons["right"].n_images, horizons["right"].fraction_images_improved) == (4, 2, 0.0)
    none = tracks.lateral_diagnostic(df.limit(0))
    assert all(f.count() == 0 for f in none.values())
