"""Arg-min lookups: each row's nearest or best reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import normal_path
from ..functions.nulls import finite


def best(df: DataFrame, by: list[str], quality: Column, order: str, keep: list[str]) -> DataFrame:
    """Of each group the row of highest quality; ties go to the least order."""
    pick = F.max_by(F.struct(*keep), F.struct(quality.alias("q"), (-F.col(order)).alias("o")))
    return df.where(quality.isNotNull()).groupBy(*by).agg(pick.alias("b")).select(*by, "b.*")


def nearest(rows: DataFrame, references: DataFrame, on: str, distance: Column, order: str, keep: list[str]) -> DataFrame:
    """Each row of rows with the reference of its key that is nearest; ties go to the least order.

    distance is an expression over both sides' columns. Rows of no reference or distance have nulls.
    rows must be unique in on.
    """
    both = rows.join(references, on)
    pick = F.min_by(F.struct(*keep, distance.alias("distance")), F.struct(distance.alias("d"), F.col(order)))
    found = both.where(distance.isNotNull()).groupBy(on).agg(pick.alias("b")).select(on, "b.*")
    return rows.join(found, on, "left")


def cascade(rows: DataFrame, levels: list[tuple[str, DataFrame, list[str]]], value: str) -> DataFrame:
    """Value and its label from the first level that has one: (label, frame unique in its keys, keys)."""
    out, picks = rows, []
    for k, (label, frame, keys) in enumerate(levels):
        name = f"_level{k}"
        out = out.join(frame.select(*keys, F.col(value).alias(name)), keys, "left")
        picks.append(F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias(value), F.lit(label).alias("level"))))
    return out.withColumn("_pick", F.coalesce(*picks)).select(*rows.columns, F.col(f"_pick.{value}").alias(value), F.coalesce("_pick.level", F.lit("none")).alias("level"))


def scale_summary(df: DataFrame, by: list[str], scale: str, limit: float = 0.04) -> DataFrame:
    """Median, deviation and variation of reference scales, with a status."""
    s = F.col(scale)
    n = F.count(s)
    sd, cv = F.when(n >= 2, F.stddev_pop(s)), F.when(n >= 2, F.stddev_pop(s) / F.nullif(F.avg(s), F.lit(0.0)))
    out = df.groupBy(*by).agg(F.median(s).alias("scale"), sd.alias("std"), cv.alias("cv"), n.alias("n"))
    return out.withColumn("status", F.when(F.col("n") == 0, "no_marker").when(F.col("cv") > limit, "low_confidence").otherwise("ok"))


def lateral_scale(images: DataFrame, references: DataFrame, calibration: DataFrame) -> DataFrame:
    """(.., scale, scale_source) of images: from their references, else from the calibration.

    images: image_path (unique), subject_id, view, feet_y. Rows of the same subject and view serve, those of the same path
    alone if there are any. The reference nearest in height to the feet gives the scale, or the median of all where
    feet or centres are unknown; the calibration's is a median. Names of the sources are fixed values.
    """
    c = F.col
    ask = images.select(normal_path(c("image_path")).alias("_path"), c("image_path").alias("_image"), c("subject_id").cast("string").alias("_subject"), F.lower("view").alias("_view"), c("feet_y").cast("double").alias("_feet"))

    def matched(df: DataFrame, scale: str, *more: str) -> DataFrame:
        other = df.select(normal_path(c("image_path")).alias("_p"), c("subject_id").cast("string").alias("_subject"), F.lower("view").alias("_view"), finite(c(scale).cast("double")).alias("_s"), *more)
        return ask.join(other, ["_subject", "_view"]).withColumn("_exact", c("_p") == c("_path"))

    def both(make) -> dict[str, Column]:
        return {f"_{n}{i}": a for i, test in enumerate((c("_exact"), F.lit(True))) for n, a in make(test & c("_s").isNotNull()).items()}

    order = [x for x in ("reference_index",) if x in references.columns]
    refs = matched(references, "reference_scale_cm_per_pixel", finite(c("center_y_px").cast("double")).alias("_y"), *order)
    gap = F.abs(c("_y") - c("_feet"))
    near = lambda t: {"near": F.min_by(F.when(t & gap.isNotNull(), c("_s")), F.when(t & gap.isNotNull(), F.struct(gap, *order, c("_s")))), "mid": F.median(F.when(t, c("_s")))}
    found = refs.groupBy("_image").agg(F.max("_exact").alias("_own"), *(a.alias(n) for n, a in both(near).items()))
    pick = lambda n: F.when(F.coalesce("_own", F.lit(False)), c(f"_{n}0")).otherwise(c(f"_{n}1"))
    found = found.select("_image", pick("near").alias("_near"), pick("mid").alias("_mid"))
    general = matched(calibration, "scale_cm_per_pixel").groupBy("_image").agg(F.max("_exact").alias("_own"), *(a.alias(n) for n, a in both(lambda t: {"cal": F.median(F.when(t, c("_s")))}).items())).select(c("_image").alias("_image2"), pick("cal").alias("_cal"))
    out = images.join(found, c("image_path") == c("_image"), "left").join(general, c("image_path") == c("_image2"), "left")
    one = F.coalesce("_near", "_mid")
    usable = F.coalesce(one > 0, F.lit(False))
    source = F.when(usable, F.when(c("_near").isNotNull(), "closest_reference_to_feet").otherwise("median_reference_scale")).when(c("_cal").isNotNull(), "image_calibration_scale").otherwise("no_valid_calibration_scale")
    return out.select(*images.columns, F.when(usable, one).otherwise(c("_cal")).alias("scale"), source.alias("scale_source"))


def perspective(df: DataFrame, by: list[str], side: Column, quality: Column, size: str, order: str, limit: float = 1.35) -> DataFrame:
    """Ratio of the sizes of the best reference in each half; flagged beyond the limit; null with one half alone."""
    halves = df.withColumn("_half", side).where(quality.isNotNull() & F.col("_half").isNotNull()).groupBy(*by, "_half")
    picked = halves.agg(F.max_by(size, F.struct(quality.alias("q"), (-F.col(order)).alias("o"))).alias("_size"))
    ratio = F.when(F.count("*") == 2, F.max("_size") / F.nullif(F.min("_size"), F.lit(0.0)))
    return picked.groupBy(*by).agg(ratio.alias("ratio")).withColumn("flagged", F.col("ratio") > limit)


def first_match(right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The right side of an N:1 join, one row for each key: that of least order."""
    rest = [c for c in right.columns if c not in keys]
    return right.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")
