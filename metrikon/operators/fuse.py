"""Fusion of left and right views and skeletal features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance
from ..functions.nulls import ratio


def subjects(df: DataFrame, subject: str, view: str, value: str) -> DataFrame:
    """By subject: mean, median, spread and deviation over lateral views, which sides there are, and the difference of their medians."""
    v = F.col(value)
    side = lambda s: F.median(F.when(F.col(view) == s, v))
    n = F.count(v)
    return df.where(F.col(subject).isNotNull() & F.col(view).isin("left", "right") & v.isNotNull()).groupBy(subject).agg(
        n.alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.when(n >= 2, F.max(v) - F.min(v)).alias("range"), F.when(n >= 2, F.stddev_pop(v)).otherwise(0.0).alias("std"),
        F.bool_or(F.col(view) == "left").alias("has_left"), F.bool_or(F.col(view) == "right").alias("has_right"), F.abs(side("left") - side("right")).alias("lr_diff"),
    )


def subject_features(df: DataFrame, subject: str, view: str, height: str, ratios: list[str]) -> DataFrame:
    """(subject, n_images, has_left, has_right, <height>_mean, _median, _std, _lr_diff, and of each ratio the mean and the difference of the sides' medians) over lateral views."""
    lateral = df.where(F.col(subject).isNotNull() & F.col(view).isin("left", "right"))
    side = lambda c, s: F.median(F.when(F.col(view) == s, F.col(c)))
    n = F.count(height)
    spread = F.when(n >= 2, F.stddev_pop(height)).when(n == 1, 0.0)
    out = [F.count("*").alias("n_images"), F.bool_or(F.col(view) == "left").alias("has_left"), F.bool_or(F.col(view) == "right").alias("has_right"), F.avg(height).alias(f"{height}_mean"), F.median(height).alias(f"{height}_median"), spread.alias(f"{height}_std")]
    out += [F.abs(side(c, "left") - side(c, "right")).alias(f"{c}_lr_diff") for c in (height, *ratios)]
    return lateral.groupBy(subject).agg(*out, *(F.avg(c).alias(f"{c}_mean") for c in ratios))


def pivot_median(df: DataFrame, row: str, column: str, values: list[str], value: str) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.median(value))


def chain_score(confidences: Column, least: float = 0.25) -> Column:
    """(number of sure points, least and mean confidence): scores compare left to right."""
    sure = F.filter(confidences, lambda c: c >= least)
    return F.struct(F.size(sure).alias("n"), F.coalesce(F.array_min(sure), F.lit(0.0)).alias("least"), F.coalesce(F.aggregate(sure, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(sure), F.lit(0)), F.lit(0.0)).alias("mean"))


def visible_side(left: Column, right: Column) -> Column:
    """The body side that the camera sees; ties go to the right."""
    return F.when(chain_score(left) > chain_score(right), "left").otherwise("right")


def skeletal(df: DataFrame, left: str, right: str, body_height: str, least: float = 0.25) -> DataFrame:
    """(.., pose_side, min_confidence, mean_confidence, segments in pixels and as shares of the body's height, status).

    left and right: arrays of (x, y, conf) of shoulder, hip, knee and ankle; a missing array has no sure points. The
    better side must have all four.
    """
    empty = F.array().cast("array<double>")
    score = {s: chain_score(F.coalesce(F.transform(F.col(c), lambda p: p["conf"].cast("double")), empty), least) for s, c in (("left", left), ("right", right))}
    out = df.withColumn("_better", score["left"] > score["right"]).withColumn("_score", F.when(F.col("_better"), score["left"]).otherwise(score["right"])).withColumn("_p", F.when(F.col("_better"), F.col(left)).otherwise(F.col(right)))
    tall, whole = F.col(body_height).cast("double"), F.col("_score.n") >= 4
    usable = F.coalesce(tall > 0, F.lit(False))
    ok = usable & whole
    segments = {n: F.when(ok, distance(*(F.get("_p", F.lit(i))[k].cast("double") for i in (a, a + 1) for k in "xy"))) for a, n in enumerate(("shoulder_hip", "hip_knee", "knee_ankle"))}
    status = F.when(~usable, "invalid_body_height_px").when(~whole, "incomplete_pose_chain").otherwise("ok")
    return out.select(
        *df.columns, F.when(ok, F.when(F.col("_better"), "left").otherwise("right")).alias("pose_side"), F.when(ok, F.col("_score.least")).alias("min_confidence"), F.when(ok, F.col("_score.mean")).alias("mean_confidence"),
        *(v.alias(f"{n}_px") for n, v in segments.items()), *(ratio(v, tall, 1e-9).alias(f"{n}_ratio") for n, v in segments.items()), status.alias("status"),
    )


def best_person(df: DataFrame, image: str, confidence: str, area: str, order: str, enough: float = 0.15) -> DataFrame:
    """Of an image's segmented persons the one of highest confidence, small ones discounted."""
    score = F.col(confidence) * F.least(F.col(area) / enough, F.lit(1.0))
    rest = [c for c in df.columns if c != image]
    return df.groupBy(image).agg(F.max_by(F.struct(*rest), F.struct(score.alias("s"), (-F.col(order)).alias("o"))).alias("p")).select(image, "p.*")
