"""Error metrics of estimates, by method and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite
from .ranks import quantiles


def of_errors(e: Column) -> dict[str, Column]:
    return {"n": F.count(e), "bias": F.avg(e), "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e))}


def error_metrics(df: DataFrame, error: str, by: list[str], empty: float | None = None) -> DataFrame:
    """n, bias, MAE and RMSE; groups without errors have nulls, or empty if given."""
    out = of_errors(F.col(error))
    if empty is not None:
        out = {k: F.coalesce(c, F.lit(empty)) if k != "n" else c for k, c in out.items()}
    return df.groupBy(*by).agg(*(c.alias(k) for k, c in out.items()))


def with_r2(df: DataFrame, truth: str, estimate: str, by: list[str]) -> DataFrame:
    """Also R squared, null for fewer than two pairs or a constant truth. Deviations are taken from the group's mean."""
    pairs = df.where(F.col(truth).isNotNull() & F.col(estimate).isNotNull())
    y = F.col(truth)
    e = F.col(estimate) - y
    total = F.var_pop(y) * F.count(y)
    r2 = F.when(F.count(y) >= 2, 1 - F.sum(e * e) / F.nullif(total, F.lit(0.0)))
    return pairs.groupBy(*by).agg(*(c.alias(k) for k, c in of_errors(e).items()), r2.alias("r2"))


def labels_of(view: Column, groups: dict[str, list[str]], everything: str = "GLOBAL") -> Column:
    """The groups a row counts in: its view, the sets that hold it, and all; a row without view in all alone."""
    inside = [F.when(view.isin(v), F.lit(g)) for g, v in groups.items()]
    return F.array_compact(F.array(view, *inside, F.lit(everything)))


def metric_matrix(df: DataFrame, methods: dict[str, str], truth: str, view: str, groups: dict[str, list[str]]) -> DataFrame:
    """(grp, method, n, bias, mae, rmse): one unpivot and one aggregation for all methods and groups."""
    errors = {m: f"_e{i}" for i, m in enumerate(methods)}
    return error_matrix(df.withColumns({e: F.col(methods[m]) - F.col(truth) for m, e in errors.items()}), errors, view, groups)


def error_matrix(df: DataFrame, methods: dict[str, str], view: str, groups: dict[str, list[str]]) -> DataFrame:
    """The same from the methods' columns of errors; groups without any error have no row."""
    pairs = F.array(*(F.struct(F.lit(m).alias("method"), finite(F.col(c)).alias("error")) for m, c in methods.items()))
    long = df.select(labels_of(F.col(view), groups).alias("grps"), F.explode(pairs).alias("p")).where("p.error IS NOT NULL")
    # aggregated by the set of groups first, so that rows are not multiplied before the shuffle
    e = F.col("p.error")
    part = long.groupBy("grps", "p.method").agg(F.count(e).alias("n"), F.sum(e).alias("s"), F.sum(F.abs(e)).alias("a"), F.sum(e * e).alias("q"))
    return part.select(F.explode("grps").alias("grp"), "method", "n", "s", "a", "q").groupBy("grp", "method").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("bias"), (F.sum("a") / F.sum("n")).alias("mae"), F.sqrt(F.sum("q") / F.sum("n")).alias("rmse"))


def whole(matrix: DataFrame, methods: list[str], groups: list[str]) -> DataFrame:
    """The matrix with a row for each method and group: n is 0 and the metrics are null where there was none."""
    grid = matrix.sparkSession.createDataFrame([(g, m) for m in methods for g in groups], "grp string, method string")
    return grid.join(matrix, ["grp", "method"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def best_method(matrix: DataFrame, by: str = "grp", name: str = "method", metric: str = "mae", order: str | None = None) -> DataFrame:
    """The name of least metric; ties go to the least order (by default the name)."""
    key = F.struct(F.col(metric).alias("x"), F.col(order or name).alias("o"), F.col(name).alias("name"))
    return matrix.where(F.col(metric).isNotNull()).groupBy(by).agg(F.min(key).alias("m")).select(by, F.col("m.name").alias(name), F.col("m.x").alias(metric))


def grouping_sets(df: DataFrame, method: str, view: str, subject: str, error: str, label: str) -> DataFrame:
    """A row for each method and view, and one for each method over all views, with its number of subjects."""
    e = F.col(error)
    rolled = df.where(F.col(view).isNotNull()).groupingSets([[method, view], [method]], method, view)
    return rolled.agg(F.countDistinct(F.when(e.isNotNull(), F.col(subject))).alias("n_subjects"), *(c.alias(k) for k, c in of_errors(e).items())).withColumn(view, F.coalesce(view, F.lit(label)))


def bland_altman(df: DataFrame, error: str, by: list[str]) -> DataFrame:
    """Bias, limits of agreement (1.96 sample deviations; none for one row), MAE and RMSE."""
    e = F.col(error)
    sd = F.coalesce(F.stddev_samp(e), F.lit(0.0))
    return df.where(e.isNotNull()).groupBy(*by).agg(F.count(e).alias("n"), F.avg(e).alias("bias"), (F.avg(e) - 1.96 * sd).alias("low"), (F.avg(e) + 1.96 * sd).alias("high"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def alignment(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, median, sample deviation, least and largest value of each group; medians from ranges of counted values, so that a few large groups are many tasks."""
    names = [f"_b{i}" for i in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*(F.col(b).alias(n) for b, n in zip(by, names, strict=True)), F.col(value).alias("_v"))
    v = F.col("_v")
    out = rows.groupBy(*names).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    middle = quantiles(rows, names, "_v", [0.5], "_q", "_n").select(*(F.col(n).alias(f"{n}_") for n in names), F.col("_q")[0].alias("median"))
    out = out.join(middle, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names])
    return out.select(*(F.col(n).alias(b) for b, n in zip(by, names, strict=True)), "n", "mean", "median", "std", "min", "max")


def improvement(df: DataFrame, before: str, after: str, by: list[str]) -> DataFrame:
    """Mean gain in absolute error and the share of rows that gain."""
    gain = F.abs(F.col(before)) - F.abs(F.col(after))
    return df.withColumn("_gain", gain).where("_gain IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), F.avg("_gain").alias("mean_gain"), F.avg((F.col("_gain") > 0).cast("double")).alias("improved"))


def pooled(df: DataFrame, by: list[str]) -> DataFrame:
    """MAE and RMSE of groups pooled by their n."""
    n = F.col("n")
    return df.groupBy(*by).agg(F.sum(n).alias("n"), (F.sum(n * F.col("mae")) / F.sum(n)).alias("mae"), F.sqrt(F.sum(n * F.col("rmse") * F.col("rmse")) / F.sum(n)).alias("rmse"))


def value_counts(df: DataFrame, *by: str) -> DataFrame:
    """Counts with nulls as a group."""
    return df.groupBy(*by).count().withColumnRenamed("count", "n")


def subject_summary(df: DataFrame, subject: str, truth: str, estimate: str) -> DataFrame:
    """Median truth, mean and median estimate of subjects that have both."""
    t, p = F.col(truth), F.col(estimate)
    return df.where(F.col(subject).isNotNull()).groupBy(subject).agg(F.median(t).alias("truth"), F.avg(p).alias("mean_estimate"), F.median(p).alias("median_estimate"), F.count(p).alias("n")).where("truth IS NOT NULL AND n > 0")
