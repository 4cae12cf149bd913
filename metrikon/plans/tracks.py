"""The tracks end to end: measurement tables and their imputation, experiments 1 and 2, the corrected horizon with its sweep, experiment 3, and the final comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import corrected_head, distance, height, plausible, upright_edge
from ..functions.geometry import horizon as horizon_row
from ..functions.nulls import optional
from ..operators import calibrate, compare, crossval, fuse, harmonize, horizon, knn, mask, metrics, nearest, pseudonym, qc, ranks
from ..operators.harmonize import Mapping
from ..sources.shared import stage
from .sites import COLUMNS, SITES

VIEWS = ("front", "back", "left", "right")
GROUPS = {"FRONT+BACK": ["front", "back"], "LEFT+RIGHT": ["left", "right"]}


def tabular(raw: dict[str, DataFrame], salt: str, sites: dict[str, Mapping] = SITES) -> dict[str, DataFrame]:
    """Sites' raw tables to preprocessed, mapping, report and flagged.

    Harmonised, flagged with bounds of their own site, passed through imputation, and pseudonymised; the mapping
    alone holds identifiers.
    """
    frames = [harmonize.equalise(df, sites[s], COLUMNS).select(F.lit(s).alias("site"), *COLUMNS) for s, df in raw.items()]
    # dealt by whole rows: small files are few tasks, and numbers are parsed once, not in each of the flags made of them
    whole = harmonize.union(frames).repartition("site", *COLUMNS)
    flagged = qc.pass_through(qc.flag(whole, "site", COLUMNS[2:]))
    marked = pseudonym.pseudonymise(flagged, "site", "ID", salt)
    values = qc.flagged_values(marked, "site", "PSEUDO_ID", "TYPE").withColumnRenamed("PSEUDO_ID", "subject_id")
    return {"preprocessed": marked.drop(qc.CELLS), "mapping": pseudonym.mapping(flagged, "site", "site", "ID", salt), "report": qc.report(marked, "site"), "flagged": values}


# Columns that tell how alike subjects are but are not filled, the compared numbers of neighbours, and the limit of correlation of the reduced mode.
DISTANCE_ONLY = ("HEIGHT_cm", "WEIGHT_kg", "PONDERAL_INDEX_kg_m3")
KS, CORRELATED = (1, 3, 5, 7, 9), 0.9
MEASUREMENTS = [c for c in COLUMNS if c not in ("ID", "TYPE", "AGE")]


def imputation(tables: DataFrame, key: str, columns: list[str] = MEASUREMENTS, targets: list[str] | None = None, site: str = "site", kind: str = "TYPE", k: int = 3, mode: str = "all", ks: tuple[int, ...] = KS) -> dict[str, DataFrame]:
    """Sites' tables to the validation of both modes by group, pooled with the best marked, the detail of one k and mode, and the tables filled with those.

    Strata are sites by kind; a site's columns are those with any value there. In mode corr each stratum leaves out columns that repeat an earlier one.
    Values flagged by quality control stay and donate; only missing ones are filled, by rows' places, not keys.
    """
    targets = [c for c in columns if c not in DISTANCE_ONLY] if targets is None else targets
    strata, limits = [site, kind], {"all": None, "corr": CORRELATED}
    tested = {m: knn.lovo_detail(tables, strata, key, columns, targets, sorted({*ks, k}), within=[site], limit=v).withColumn("feature_mode", F.lit(m)) for m, v in limits.items()}
    both = tested["all"].unionByName(tested["corr"]).where(F.col("k").isin(*ks))
    e = F.col("predicted") - F.col("truth")
    by_group = both.groupBy(*strata, "feature_mode", "k").agg(F.count("*").alias("n_tested"), F.bround(F.avg(F.abs(e)), 3).alias("mae"), F.bround(F.sqrt(F.avg(e * e)), 3).alias("rmse"))
    n = F.sum("n_tested")
    # a line for each mode and k, from groups' figures as they are reported
    pooled = by_group.groupBy("feature_mode", "k").agg(n.alias("n_tested"), F.bround(F.sum(F.col("n_tested") * F.col("mae")) / n, 3).alias("mae"), F.bround(F.sqrt(F.sum(F.col("n_tested") * F.col("rmse") * F.col("rmse")) / n), 3).alias("rmse"))
    best = pooled.agg(F.min(F.struct("mae", "feature_mode", "k")).alias("b"))
    summary = pooled.crossJoin(F.broadcast(best)).withColumn("best", (F.col("feature_mode") == F.col("b.feature_mode")) & (F.col("k") == F.col("b.k"))).drop("b")  # one row
    detail = tested[mode].where(F.col("k") == k).select(
        *strata, "feature_mode", "k", F.col(key).cast("string").alias("subject_id"), "column", F.bround("truth", 3).alias("true_value"), F.bround("predicted", 3).alias("predicted_value"),
        F.bround(F.abs(e), 3).alias("abs_error"), F.col("used").alias("n_neighbors_used"), F.col("donors").alias("neighbor_ids"),
    )
    rows = knn.numbered(tables, "_place")
    filled = knn.complete(rows, knn.impute(rows, strata, key, columns, targets, k, row="_place", within=[site], limit=limits[mode]), "_place", targets)
    return {"by_group": by_group, "summary": summary, "detail": detail, "complete": filled}


SCALES = {"median_scale": "scale_median_all", "best_quality_scale": "scale_best_quality", "closest_feet_scale": "scale_closest_feet", "ground_line_scale": "scale_ground_line"}


def experiment_1(images: DataFrame, calibration: DataFrame, references: DataFrame, manual: DataFrame) -> DataFrame:
    """Heights of images from four reference scales, with errors, the scales' origins, perspective and status.

    images: one row for each image_path with site, subject_id, view, image_width, landmark_status, height_px, feet_x_px,
    feet_y_px. calibration: image_path, calibration_status, scale_cm_per_pixel; the first by row_order counts.
    references: image_path, reference_index, center_x_px, center_y_px, reference_scale_cm_per_pixel, detection_quality.
    manual: ID, HEIGHT_cm, row_order. Images without calibration, marker or scale take no part.
    """
    c = F.col
    first = nearest.first_match(calibration.select("image_path", "row_order", "calibration_status", "scale_cm_per_pixel"), ["image_path"], "row_order").drop("row_order")
    eligible = first.where((c("calibration_status") != "no_marker_detected") & c("scale_cm_per_pixel").isNotNull())
    known = nearest.first_match(manual.select(c("ID").cast("string").alias("subject_id"), "row_order", c("HEIGHT_cm").cast("double").alias("height_manual_cm")), ["subject_id"], "row_order").drop("row_order")
    rows = images.join(eligible, "image_path").withColumn("subject_id", c("subject_id").cast("string")).join(known, "subject_id", "left")
    refs = rows.select("image_path", "feet_x_px", "feet_y_px", "image_width").join(references, "image_path").withColumn("scale", c("reference_scale_cm_per_pixel"))
    away = distance(c("center_x_px"), c("center_y_px"), c("feet_x_px"), c("feet_y_px"))
    drop = F.abs(c("center_y_px") - c("feet_y_px"))
    of = lambda d: F.min_by(F.when(d.isNotNull(), F.struct("scale", "reference_index", d.alias("by"))), F.when(d.isNotNull(), F.struct(d, c("reference_index"))))
    picks = refs.groupBy("image_path").agg(of(-c("detection_quality")).alias("best"), of(away).alias("feet"), of(drop).alias("line"))
    tilted = nearest.perspective(refs, ["image_path"], c("center_x_px") < c("image_width") / 2, c("detection_quality"), "scale", "reference_index")
    out = rows.join(picks, "image_path", "left").join(tilted, "image_path", "left")
    ok = c("landmark_status").startswith("ok")
    out = out.select(
        "image_path", "site", "subject_id", "view", "height_manual_cm", "height_px", c("scale_cm_per_pixel").alias("scale_median_all"), c("best.scale").alias("scale_best_quality"), c("best.reference_index").alias("best_quality_reference_index"),
        c("feet.scale").alias("scale_closest_feet"), c("feet.reference_index").alias("closest_feet_reference_index"), c("feet.by").alias("closest_feet_distance_px"), c("line.scale").alias("scale_ground_line"),
        c("line.reference_index").alias("ground_line_reference_index"), c("line.by").alias("ground_line_delta_y_px"), c("ratio").alias("cube_scale_ratio"), F.coalesce("flagged", F.lit(False)).alias("perspective_flag"),
        F.when(ok, "ok").otherwise(F.concat(F.lit("landmark_failed_"), "landmark_status")).alias("status"),
    )
    out = out.withColumns({f"height_cm_{m}": c("height_px") * c(s) for m, s in SCALES.items()})
    return out.withColumns({f"error_cm_{m}": c(f"height_cm_{m}") - c("height_manual_cm") for m in SCALES})


def corrected_scale(estimates: DataFrame, method: str = "ground_line_scale", by: str = "view") -> DataFrame:
    """Adds the method's heights by leave-one-out lines and their errors."""
    out = calibrate.leave_one_out(estimates, f"height_cm_{method}", "height_manual_cm", [by], name=f"height_cm_{method}_corrected")
    return out.withColumn(f"error_cm_{method}_corrected", F.col(f"height_cm_{method}_corrected") - F.col("height_manual_cm"))


#: Height of the camera, side of a marker, both in cm.
CAMERA_CM, MARKER_CM = 100.0, 10.0


def experiment_2(images: DataFrame, runs: DataFrame, markers: DataFrame, manual: DataFrame, camera_cm: float = CAMERA_CM, marker_cm: float = MARKER_CM) -> dict[str, DataFrame]:
    """Heights from each image's own horizon and from the one its subject's front and back views share.

    images: one row for each image_path with site, subject_id, view, img_h, landmark_status, feet_y and head_y of the pose. runs: masks as
    (image_path, y, x0, x1). markers: image_path, marker_index, corners (four structs of x and y). manual: ID, HEIGHT_cm, row_order; the first counts.

    estimates: one row for each image. In lateral views the mask's lowest line replaces the feet unless it lies over 5 pixels above them; the trimmed
    mask's head replaces the pose's where it moves at most 12 % of the body (and rises 30 pixels at most in lateral views). The marker nearest to the feet gives the image's horizon.
    alignment: by view, how far images' horizons lie from the shared ones. pivot: their medians by subject and view. summary: errors of the
    shared horizon by view, for front and back, and for all, zeros where there are none. matrix: errors of all four heights by group.
    """
    c = F.col
    number = lambda name: F.lit(None).cast("double").alias(name)
    known = nearest.first_match(manual.select(c("ID").cast("string").alias("subject_id"), "row_order", c("HEIGHT_cm").cast("double").alias("height_manual_cm")), ["subject_id"], "row_order").drop("row_order")
    body = mask.ends(runs, [0.5]).select("image_path", c("lowest").cast("double").alias("y_feet_mask"), c("head_y").cast("double").alias("_mask_head"))
    ok = c("landmark_status").startswith("ok")
    rows = images.withColumn("subject_id", c("subject_id").cast("string")).join(known, "subject_id", "left").join(body, "image_path", "left")
    single, lateral = c("feet_y").cast("double"), c("view").isin("left", "right")
    soled = F.coalesce(lateral & (c("y_feet_mask") >= single - 5), F.lit(False))
    rows = rows.withColumns({"y_feet_single": single, "y_feet": F.when(soled, c("y_feet_mask")).otherwise(single), "feet_source": F.when(soled, "mask_bottom").otherwise("pose")})
    rows = rows.withColumns(corrected_head(c("view"), c("head_y").cast("double"), c("_mask_head"), c("y_feet")))
    # of the markers with an upright side the one nearest to the feet, the first of equals; an image's markers are few
    edge = markers.select("image_path", "marker_index", upright_edge(c("corners")).alias("edge"), (sum((c("corners")[i]["y"] for i in range(1, 4)), c("corners")[0]["y"]) / 4).alias("middle"))
    found = edge.groupBy("image_path").agg(F.collect_list(F.struct("middle", "marker_index", "edge")).alias("_edges"))
    near = F.transform("_edges", lambda m: F.struct(F.abs(m["middle"] - c("y_feet")).alias("away"), m["marker_index"].alias("marker_index"), m["edge"].alias("edge")))
    pick = F.array_min(F.filter(near, lambda m: m["edge"].isNotNull() & m["away"].isNotNull()))
    rows = rows.join(found, "image_path", "left").withColumns({"pick": pick, "_any": F.when(c("_edges").isNotNull(), F.lit(True))}).drop("_edges")
    y_cube = horizon_row(c("pick.edge.base_y"), c("pick.edge.top_y"), F.lit(camera_cm), F.lit(marker_cm))
    h_cube = height(F.lit(camera_cm), c("y_feet"), c("head_y"), c("_y"), "a")
    status = F.when(~ok, F.concat(F.lit("person_failed_"), F.coalesce("landmark_status", F.lit("")))).when(c("_any").isNull(), "no_aruco").when(c("pick").isNull(), "no_cube_edge")
    rows = rows.withColumn("_y", y_cube).withColumn("_h", h_cube)
    rows = rows.withColumn("status", status.when(F.coalesce(plausible(c("_h")), F.lit(False)), "ok").otherwise("horizon_out_of_range"))
    own = {"y_horizon_cube": c("_y"), "H_horizon_cube": c("_h"), "y_feet": c("y_feet"), "y_head": c("head_y"), "height_px": c("y_feet") - c("head_y"), "y_feet_single": c("y_feet_single"), "y_feet_mask": c("y_feet_mask")}
    person = F.coalesce(ok, F.lit(False))  # without a person there is nothing to measure
    rows = rows.select(
        "site", "subject_id", "view", "image_path", "status", "img_h", "height_manual_cm", *(F.when(person, v).alias(n) for n, v in own.items()),
        F.when(person, c("feet_source")).otherwise("pose").alias("feet_source"), F.when(person, c("head_source")).otherwise("pose").alias("head_source"), F.when(person, c("head_move_px")).otherwise(0.0).alias("head_move_px"),
    )
    rows = stage(rows, "experiment-2-own")  # read three times
    given = horizon.shared(rows, "subject_id", "y_horizon_cube", horizon.valid_donor(c("view"), horizon.FRONT_BACK, c("status"), c("y_horizon_cube")))
    given = given.withColumn("shared_source", F.coalesce("shared_source", F.lit("global"))).withColumnsRenamed({"shared": "y_horizon_ref", "shared_source": "horizon_ref_source"})
    delta, e = c("y_horizon_cube") - c("y_horizon_ref"), lambda h: h - c("height_manual_cm")
    from_ref = {"H_horizon_shared": "y_feet", "H_shared_feet_single": "y_feet_single", "H_shared_feet_mask": "y_feet_mask"}
    out = given.withColumns({"delta_horizon_px": delta, "delta_horizon_frac": F.when(c("img_h") > 0, delta / c("img_h"))} | {h: height(F.lit(camera_cm), c(y), c("y_head"), c("y_horizon_ref"), "a") for h, y in from_ref.items()})
    errors = {"error_horizon_shared": "H_horizon_shared", "error_horizon_cube": "H_horizon_cube", "error_feet_single": "H_shared_feet_single", "error_feet_mask": "H_shared_feet_mask"}
    out = stage(out.withColumns({n: e(c(h)) for n, h in errors.items()}), "experiment-2")
    moved = out.where("delta_horizon_px IS NOT NULL AND view IS NOT NULL")
    names = {"mean": "mean_px", "median": "median_px", "std": "std_px", "min": "min_px", "max": "max_px"}
    alignment = metrics.alignment(moved, "delta_horizon_px", ["view"]).withColumnsRenamed(names)
    pivot = fuse.pivot_median(moved.where("subject_id IS NOT NULL"), "subject_id", "view", list(VIEWS), "delta_horizon_px")
    sets = {"FRONT+BACK": GROUPS["FRONT+BACK"]}
    always = out.sparkSession.range(1).select(F.explode(F.array(F.lit("FRONT+BACK"), F.lit("GLOBAL"))).alias("grupo"), number("e"))  # both have a line whatever there is
    each = out.select(F.explode(metrics.labels_of(c("view"), sets)).alias("grupo"), c("error_horizon_shared").alias("e")).unionByName(always)
    summary = metrics.error_metrics(each, "e", ["grupo"], 0.0).select("grupo", "n", *(F.bround(m, 1).alias(f"{m}_cm") for m in ("bias", "mae", "rmse")))
    methods = {"cube": "error_horizon_cube", "shared": "error_horizon_shared", "feet_single": "error_feet_single", "feet_mask": "error_feet_mask"}
    return {"estimates": out, "alignment": alignment, "pivot": pivot, "summary": summary, "matrix": metrics.error_matrix(out, methods, "view", sets)}


def lateral_diagnostic(estimates: DataFrame, camera_cm: float = CAMERA_CM) -> dict[str, DataFrame]:
    """Own against shared horizon in lateral views, from estimates of experiment 2: what the error would be with either.

    estimates: subject_id, view, status, y_head, y_feet, y_horizon_cube, y_horizon_ref, height_manual_cm; of them images of lateral views that are ok.
    predictions: one row for each image. views: n, bias, MAE, RMSE and R squared of both horizons by view and for all, with the subjects. subjects: means and medians over a subject's
    images; those without a manual height have no row. subject_summary: the metrics after that fusion. horizons: by view and for all, how far the own horizons lie and how often they help.
    """
    c = F.col
    kept = estimates.withColumn("view", F.lower("view")).where(c("view").isin("left", "right") & (c("status") == "ok"))
    names = {"own": "per_image", "shared": "shared"}
    rows = kept.select("*", F.lit(float(camera_cm)).alias("_camera"), F.lit(None).cast("double").alias("_tall"))
    out = horizon.diagnose(rows, "_camera", "y_feet", "y_head", "y_horizon_cube", "y_horizon_ref", "height_manual_cm", "_tall").drop("_camera", "_tall", "delta_share")
    for k, n in names.items():
        out = out.withColumnsRenamed({f"h_{k}": f"pred_{n}_horizon_cm", f"error_{k}": f"error_{n}_horizon_cm", f"abs_error_{k}": f"abs_error_{n}_horizon_cm"})
    out = out.withColumnsRenamed({"improvement": "improvement_per_image_vs_shared_cm", "delta_px": "horizon_delta_px"})
    out = out.withColumns({"body_height_px": c("y_feet") - c("y_head"), "feet_to_cube_horizon_px": c("y_feet") - c("y_horizon_cube"), "feet_to_shared_horizon_px": c("y_feet") - c("y_horizon_ref")})
    out = stage(out, "lateral")
    label = F.explode(F.array("view", F.lit("LATERAL_GLOBAL"))).alias("group")

    def scored(df: DataFrame, methods: dict[str, str], groups: DataFrame) -> DataFrame:
        """Metrics by group and method; a group of which a method has none is there with nulls."""
        long = df.select("group", "height_manual_cm", F.explode(F.array(*(F.struct(F.lit(m).alias("method"), c(x).alias("estimate")) for m, x in methods.items()))).alias("m")).select("group", "height_manual_cm", "m.*")
        grid = groups.withColumn("method", F.explode(F.array(*map(F.lit, methods))))
        found = metrics.with_r2(long, "height_manual_cm", "estimate", ["group", "method"]).withColumnsRenamed({"bias": "bias_cm", "mae": "mae_cm", "rmse": "rmse_cm"})
        return grid.join(found, ["group", "method"], "left").withColumn("n", F.coalesce("n", F.lit(0)))

    by_view = out.select("*", label)
    counted = by_view.groupBy("group").agg(F.countDistinct("subject_id").alias("n_subjects"))
    views = scored(by_view, {"per_image_cube_horizon": "pred_per_image_horizon_cm", "shared_subject_horizon": "pred_shared_horizon_cm"}, counted)
    both = {f"pred_{n}_horizon_{kind}_cm": f(f"pred_{n}_horizon_cm") for n in names.values() for kind, f in (("mean", F.avg), ("median", F.median))}
    own = c("pred_per_image_horizon_cm")
    subjects = out.where("subject_id IS NOT NULL").groupBy("subject_id").agg(
        F.median("height_manual_cm").alias("height_manual_cm"), F.count("*").alias("n_lateral_images"), F.bool_or(c("view") == "left").alias("has_left"), F.bool_or(c("view") == "right").alias("has_right"), *(v.alias(k) for k, v in both.items()),
        F.avg("y_horizon_cube").alias("mean_cube_horizon_px"), F.avg("y_horizon_ref").alias("mean_shared_horizon_px"), F.avg("horizon_delta_px").alias("mean_horizon_delta_px"), F.when(F.count(own) >= 2, F.max(own) - F.min(own)).alias("left_right_prediction_difference_cm"),
    )
    subjects = subjects.where("height_manual_cm IS NOT NULL").withColumns({f"error_{n}_horizon_mean_cm": c(f"pred_{n}_horizon_mean_cm") - c("height_manual_cm") for n in names.values()})
    level = subjects.withColumn("group", F.lit("SUBJECT_LEVEL"))
    fused = {f"{n}_horizon_left_right_{kind}": f"pred_{n}_horizon_{kind}_cm" for n in names.values() for kind in ("mean", "median")}
    summary = scored(level, fused, level.groupBy("group").agg(F.countDistinct("subject_id").alias("n_subjects")))
    gain = c("improvement_per_image_vs_shared_cm")
    count = by_view.groupBy("group").agg(F.count("*").alias("n_images"), F.avg(gain).alias("mean_error_improvement_cm"), F.avg((gain > 0).cast("double")).alias("fraction_images_improved"))
    moved = metrics.alignment(by_view, "horizon_delta_px", ["group"]).drop("n")
    moved = moved.withColumnsRenamed({k: f"{k}_horizon_delta_px" for k in ("mean", "median", "std", "min", "max")})
    middle = ranks.quantiles(by_view.select("group", gain.alias("g")), ["group"], "g", [0.5], "q", "_n").select("group", c("q")[0].alias("median_error_improvement_cm"))
    return {"predictions": out, "views": views, "subjects": subjects, "subject_summary": summary, "horizons": count.join(moved, "group", "left").join(middle, "group", "left")}


def corrected_horizon(images: DataFrame, by: str | None = None) -> DataFrame:
    """Adds H_horizon_cube, the horizon hierarchy, H_horizon_corrected and its error.

    images: subject_id, view, status, camera_cm, y_feet, y_head, y_horizon_cube, height_manual_cm; with by, each of its values is an experiment of its own.
    """
    c = F.col
    own = images.withColumn("H_horizon_cube", height(c("camera_cm"), c("y_feet"), c("y_head"), c("y_horizon_cube"), "b"))
    out = horizon.correct(own, "subject_id", "view", "y_horizon_cube", "status", "H_horizon_cube", by)
    out = out.withColumn("H_horizon_corrected", height(c("camera_cm"), c("y_feet"), c("y_head"), c("y_horizon_corrected"), "b"))
    return out.withColumn("error_horizon_corrected", c("H_horizon_corrected") - c("height_manual_cm"))


def head_width_sweep(runs: DataFrame, images: DataFrame, shares: tuple[float, ...] = (0.45, 0.50, 0.55, 0.60), image: str = "image_path") -> DataFrame:
    """(share, n_fb, mae_front_back, mae_left, mae_right, best): the corrected horizon for several shares of the skull's width, in one job with the share as a column.

    images as for corrected_horizon, with the pose's y_head; the trimmed mask's head replaces it where it moves at most 12 % of the body.
    """
    c = F.col
    heads = mask.head_sweep(runs, list(shares), image).select(image, "share", c("head_y").cast("double").alias("_mask_head"))
    each = images.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares)))).join(heads, [image, "share"], "left")
    moved = corrected_head(c("view"), c("y_head"), c("_mask_head"), c("y_feet"), rise_px=None)["head_y"]
    each = stage(each.withColumn("y_head", moved).drop("_mask_head"), "head-widths")  # medians and donors read it several times
    e = corrected_horizon(each, "share")
    mae = lambda views: F.avg(F.abs(F.when(c("view").isin(*views), c("error_horizon_corrected"))))
    found = e.groupBy("share").agg(F.count(F.when(c("view").isin("front", "back"), c("error_horizon_corrected"))).alias("n_fb"), mae(["front", "back"]).alias("mae_front_back"), mae(["left"]).alias("mae_left"), mae(["right"]).alias("mae_right"))
    best = found.agg(F.min(F.struct("mae_front_back", "share")).alias("b")).select(c("b.share").alias("_best"))
    return found.crossJoin(F.broadcast(best)).withColumn("best", c("share") == c("_best")).drop("_best")  # one row


RATIOS = ["shoulder_hip_ratio", "hip_knee_ratio", "knee_ankle_ratio"]
FUSED = ["initial_height_cm_mean", "initial_height_cm_lr_diff", *(f"{r}_mean" for r in RATIOS)]


def skeletal(images: DataFrame, references: DataFrame, calibration: DataFrame, manual: DataFrame) -> dict[str, DataFrame]:
    """Experiment 3: images with scale and segments, subjects, predictions by nested cross-validation, their metrics, and the model's coefficients.

    images: lateral views with image_path, subject_id, view, feet_y, body_height_px and the chains left and right. manual: subject_id, height_manual_cm.
    Subjects without height or features of their own take no part in the models.
    """
    lateral = nearest.lateral_scale(images.where(F.col("view").isin("left", "right")), references, calibration)
    found = fuse.skeletal(lateral, "left", "right", "body_height_px").withColumn("initial_height_cm", F.col("body_height_px") * F.col("scale"))
    subjects = fuse.subject_features(found.where("status = 'ok'"), "subject_id", "view", "initial_height_cm", RATIOS).join(manual.select("subject_id", "height_manual_cm"), "subject_id", "left")
    usable = subjects.where("height_manual_cm IS NOT NULL AND initial_height_cm_mean IS NOT NULL")
    predicted = crossval.nested(usable, "subject_id", "height_manual_cm", FUSED)
    models = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("estimate")) for m in ("mean_model", "raw_model", "ols_model", "ridge_model"))))
    scored = metrics.with_r2(predicted.select("height_manual_cm", models.alias("m")).select("height_manual_cm", "m.*"), "height_manual_cm", "estimate", ["model"])
    fitted = crossval.coefficients(usable, "subject_id", "height_manual_cm", FUSED, crossval.median_alpha(predicted))
    return {"images": found, "subjects": subjects, "predictions": predicted, "metrics": scored, "coefficients": fitted}


def render_spec(estimates: DataFrame, methods: dict[str, tuple[str, str | None]], truth: str = "height_manual_cm") -> DataFrame:
    """(image_path, method, title, lines, points): what a drawing of an estimate shows; drawing itself is left to others.

    methods: name to (column of the height, column of the horizon's row or none). estimates: head_x, head_y, feet_x, feet_y too. Estimates that are null have no row.
    """
    c = F.col
    point = lambda name: F.struct(F.lit(name).alias("name"), c(f"{name}_x").cast("double").alias("x"), c(f"{name}_y").cast("double").alias("y"))
    cm = lambda v: F.format_number(v, 1)

    def one(name: str, height_: str, line: str | None) -> F.Column:
        title = F.concat_ws(" ", F.lit(name), F.concat(cm(c(height_)), F.lit(" cm")), F.when(c(truth).isNotNull(), F.concat(F.lit("("), cm(c(height_) - c(truth)), F.lit(")"))))
        y = c(line).cast("double") if line else F.lit(None).cast("double")
        return F.when(c(height_).isNotNull(), F.struct(F.lit(name).alias("method"), title.alias("title"), F.when(y.isNotNull(), F.array(F.struct(F.lit("horizon").alias("name"), y.alias("y")))).otherwise(F.array().cast("array<struct<name:string,y:double>>")).alias("lines")))

    specs = F.array_compact(F.array(*(one(m, h, y) for m, (h, y) in methods.items())))
    points = F.filter(F.array(point("head"), point("feet")), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return estimates.select("image_path", F.explode(specs).alias("s"), points.alias("points")).select("image_path", "s.*", "points")


# The compared methods and the columns of their errors.
METHODS = {
    "E1 mediana escalas": "e1_err_median",
    "E1 escala mejor calidad": "e1_err_bestquality",
    "E1 escala cercana a pies": "e1_err_closestfeet",
    "E1 escala suelo": "e1_err_groundline",
    "E1 suelo corregida LOO*": "e1_err_groundline_corr",
    "HZ vía cubo": "hz_err_cube",
    "HZ compartido": "hz_err_shared",
    "HZ compartido pie single": "hz_err_feet_single",
    "HZ compartido pie mask": "hz_err_feet_mask",
    "HZ corregido final LOO": "hzc_err_corrected",
}
E1 = {
    "e1_height_px": "height_px",
    "e1_scale_median_cmpx": "scale_median",
    "e1_H_median": "height_cm_median_scale",
    "e1_err_median": "error_cm_median_scale",
    "e1_scale_bestquality_cmpx": "scale_best_quality",
    "e1_H_bestquality": "height_cm_best_quality_scale",
    "e1_err_bestquality": "error_cm_best_quality_scale",
    "e1_scale_closestfeet_cmpx": "scale_closest_feet",
    "e1_H_closestfeet": "height_cm_closest_feet_scale",
    "e1_err_closestfeet": "error_cm_closest_feet_scale",
    "e1_scale_groundline_cmpx": "scale_ground_line",
    "e1_H_groundline": "height_cm_ground_line_scale",
    "e1_err_groundline": "error_cm_ground_line_scale",
    "e1_H_groundline_corr": "height_cm_ground_line_scale_corrected",
    "e1_err_groundline_corr": "error_cm_ground_line_scale_corrected",
}
HZ = {"hz_height_px": "height_px", "hz_y_horizon_cube": "y_horizon_cube", "hz_y_horizon_shared": "y_horizon_shared", "hz_H_cube": "H_horizon_cube", "hz_err_cube": "error_horizon_cube", "hz_H_shared": "H_horizon_shared", "hz_err_shared": "error_horizon_shared", "hz_err_feet_single": "error_feet_single", "hz_err_feet_mask": "error_feet_mask"}
HZC = {"hzc_height_px": "height_px", "hzc_y_horizon_corrected": "y_horizon_corrected", "hzc_H_corrected": "H_horizon_corrected", "hzc_err_corrected": "error_horizon_corrected"}
IDS = {"site": "string", "subject_id": "string", "view": "string", "height_manual_cm": "double"}


def compare_methods(e1: DataFrame, hz: DataFrame, hzc: DataFrame) -> dict[str, DataFrame]:
    """wide: one row for each image of any experiment; matrix: 10 methods by 7 groups; mae: methods by groups; sources; best.

    Columns that an experiment lacks are null: so is e1_scale_median_cmpx, as experiment 1 names its median scale_median_all.
    """
    def part(df: DataFrame, names: dict[str, str], kinds: dict[str, str]) -> DataFrame:
        return df.select("image_path", *(optional(df, c, k).alias(c) for c, k in kinds.items()), *(optional(df, c).alias(n) for n, c in names.items()))

    hz_scales = {"hz_scale_cube_cmpx": "hz_H_cube", "hz_scale_shared_cmpx": "hz_H_shared"}
    b = part(hz, HZ, {}).withColumns({n: compare.equivalent_scale(F.col(h), F.col("hz_height_px")) for n, h in hz_scales.items()})
    labels = {"horizon_corrected_source": "hzc_horizon_source", "height_reliability": "hzc_reliability"}
    d = part(hzc, HZC, {c: "string" for c in labels}).withColumnsRenamed(labels).withColumn("hzc_scale_equivalent_cmpx", compare.equivalent_scale(F.col("hzc_H_corrected"), F.col("hzc_height_px")))
    wide = compare.outer_on([part(e1, E1, IDS), b, d], "image_path")
    wide = compare.ids_first(wide, ["site", "subject_id", "view", "image_path", "height_manual_cm"])
    groups = [*VIEWS, *GROUPS, "GLOBAL"]
    matrix = metrics.whole(metrics.error_matrix(wide, METHODS, "view", GROUPS), list(METHODS), groups)
    return {"wide": wide, "matrix": matrix, "mae": compare.matrix_wide(matrix, groups), "sources": metrics.value_counts(wide, "view", "hzc_horizon_source", "hzc_reliability"), "best": metrics.best_method(matrix)}
