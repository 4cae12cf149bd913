"""Leave-one-out calibration and parameter sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import crown
from .metrics import of_errors

#: From 0.60 to 2.00 by 0.05.
FACTORS = [round(0.6 + 0.05 * i, 2) for i in range(29)]


def leave_one_out(df: DataFrame, x: str, y: str, by: list[str], least: int = 8, name: str = "corrected") -> DataFrame:
    """y predicted by the line through the group's other rows; x itself in groups under least rows or where no line is.

    A closed form: the group's centred sums, from one aggregation, less the row's own share. Rows without x, y or a group's
    key stay, without a prediction.
    """
    fx, fy = F.col(x), F.col(y)
    both = fx.isNotNull() & fy.isNotNull()
    of = lambda c: F.when(both, c)
    sums = df.groupBy(*by).agg(F.count(of(fx)).alias("_n"), F.avg(of(fx)).alias("_mx"), F.avg(of(fy)).alias("_my"), F.var_pop(of(fx)).alias("_vx"), F.covar_pop(of(fx), of(fy)).alias("_cxy"))
    keys = [c for c in sums.columns if c in by]
    sums = sums.withColumnsRenamed({c: "_" + c for c in keys})
    out = df.join(sums, [F.col(c) == F.col("_" + c) for c in keys], "left") if by else df.crossJoin(F.broadcast(sums))  # without groups: one row
    n, dx, dy = F.col("_n"), fx - F.col("_mx"), fy - F.col("_my")
    # without row j the centred sums lose n / (n - 1) times its own products
    sxx, sxy = n * F.col("_vx") - n / (n - 1) * dx * dx, n * F.col("_cxy") - n / (n - 1) * dx * dy
    slope = F.when(sxx > 1e-12 * n * F.col("_vx"), sxy / sxx)
    predicted = F.col("_my") - dy / (n - 1) + slope * (dx + dx / (n - 1))
    return out.withColumn(name, F.when(both & n.isNotNull(), F.when(n >= least, F.coalesce(predicted, fx)).otherwise(fx))).select(*df.columns, name)


def before_after(df: DataFrame, truth: str, before: str, after: str, view: str) -> DataFrame:
    """n, bias, MAE and RMSE of both, by view and over all."""
    b, a = F.col(before) - F.col(truth), F.col(after) - F.col(truth)
    rolled = df.where(b.isNotNull() & a.isNotNull()).groupingSets([[view], []], view)
    cols = {f"{k}_before": c for k, c in of_errors(b).items() if k != "n"} | {f"{k}_after": c for k, c in of_errors(a).items() if k != "n"}
    return rolled.agg(F.count("*").alias("n"), *(c.alias(k) for k, c in cols.items())).withColumn(view, F.coalesce(view, F.lit("GLOBAL")))


def sweep(df: DataFrame, values: list[float], name: str, error: Column, by: list[str] | None = None) -> DataFrame:
    """Metrics of an error that depends on a parameter, for each of its values: the values meet each row inside it, in one pass."""
    rows = df.withColumn(name, F.explode(F.array(*(F.lit(float(v)) for v in values)))).withColumn("_e", error)
    return rows.groupBy(name, *(by or [])).agg(*(c.alias(k) for k, c in of_errors(F.col("_e")).items()))


def best_value(swept: DataFrame, name: str, metric: str = "mae") -> DataFrame:
    """The least value of the parameter among those of least metric."""
    return swept.where(F.col(metric).isNotNull()).agg(F.min(F.struct(metric, name)).alias("m")).select(f"m.{name}", f"m.{metric}").where(F.col(name).isNotNull())


def crown_sweep(df: DataFrame, factors: list[float] = FACTORS, scale: str = "scale_closest_feet") -> DataFrame:
    """(factor, n, bias, mae, rmse) of heights whose crown is set anew for each factor in rows of face mode interocular; others keep theirs.

    df: feet_y_px, head_y_px, head_y_mask, pose_eye_y, pose_face_scale, pose_face_mode, height_manual_cm and the scale.
    """
    c = F.col
    rows = df.dropna(subset=["feet_y_px", scale, "height_manual_cm"])
    moved = crown(c("pose_eye_y"), c("pose_face_scale"), c("factor"), c("head_y_mask"))
    head = F.when(c("pose_face_mode") == "interocular", moved).otherwise(c("head_y_px"))
    return sweep(rows, factors, "factor", (c("feet_y_px") - head) * c(scale) - c("height_manual_cm"))
