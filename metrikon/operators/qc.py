"""Quality control: missing, out-of-range and outlying values, row flags and reports.

Flags are made inside each wide row, so that only the bounds (a row for each site) and the
reports are aggregated; rows without identifier or with a repeated one are rows like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite, joined
from . import ranks

# Physiological bounds, inclusive; the unit is in the column's name.
RANGES = {
    "AGE": (1, 100),
    "HEIGHT_cm": (90, 210),
    "WEIGHT_kg": (12, 200),
    "PONDERAL_INDEX_kg_m3": (9, 45),
    "PER_Skull_cm": (44, 64),
    "PER_Neck_cm": (20, 55),
    "THICK_WingedNeck_cm": (8, 41),
    "DIST_SupScapularAngToC7_AVG_cm": (3, 16),
    "DIST_SupScapularAngToT10_AVG_cm": (6, 29),
    "DIST_C7ToT10_cm": (7, 35),
    "LONG_Arm_AVG_cm": (25, 129),
    "DIST_UpperArm_AVG_cm": (11, 55),
    "DIST_Forearm_AVG_cm": (8, 43),
    "DIST_Hand_AVG_cm": (6, 32),
    "LONG_Leg_AVG_cm": (28, 144),
    "DIST_Thigh_AVG_cm": (14, 72),
    "DIST_LowerLeg_LATERAL_AVG_cm": (14, 72),
    "DIST_LowerLeg_MEDIAL_AVG_cm": (14, 72),
    "DIST_Foot_AVG_cm": (5, 26),
    "PER_Abdominal_cm": (40, 160),
    "DIST_BetweenSupAntIliacCrest_cm": (11, 56),
    "PER_Hip_cm": (45, 175),
    "DIST_SternalEndClavicleToSternalManubrium_AVG_cm": (0.2, 6),
    "DIST_ManubriumToXiphoidApophysis_cm": (6, 29),
    "DIST_ManubriumToCentralNavel_cm": (14, 71),
}

CELLS = "QC_CELLS"


def iqr_bounds(df: DataFrame, site: str, columns: list[str], exempt: tuple[str, ...] = ("AGE",), least: int = 5) -> DataFrame:
    """(site, column, low, high): Tukey fences with exact quartiles; none under five values or without spread, nor for exempt columns.

    The quartiles come from counts of distinct values by ranges, so that a site with most of the rows is many tasks.
    """
    kept = [c for c in columns if c not in exempt]
    if not kept:
        return df.select(site, F.lit("").alias("column"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high")).limit(0)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), finite(F.col(c).cast("double")).alias("value")) for c in kept)))
    out = ranks.quantiles(df.select(F.col(site).alias("_site"), each.alias("c")).select("_site", "c.*"), ["_site", "column"], "value", [0.25, 0.75], "q")
    spread = F.col("q")[1] - F.col("q")[0]
    return out.where((F.col("n") >= least) & (spread != 0)).select(F.col("_site").alias(site), "column", (F.col("q")[0] - 1.5 * spread).alias("low"), (F.col("q")[1] + 1.5 * spread).alias("high"))


def flag(df: DataFrame, site: str, columns: list[str], ranges: dict[str, tuple[float, float]] = RANGES, bounds: DataFrame | None = None) -> DataFrame:
    """The rows with QC_FLAGS and QC_COLUMNS (sorted ;-joined sets), QC_N_FLAGS (flagged columns) and QC_CELLS, an array of (column, value, flags).

    A missing cell (NaN and infinities among them) has that flag alone, another up to two. bounds (site, column, low, high) may be given, as for streams.
    A null site is a site of its own.
    """
    bounds = iqr_bounds(df, site, columns) if bounds is None else bounds
    fences = bounds.groupBy(F.col(site).alias("_site")).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("low", "high").alias("f")))).alias("_fences"))
    marked = df.join(fences, F.col(site).eqNullSafe(F.col("_site")), "left")  # a row for each site; its size decides how it is joined

    def cell(c: str) -> Column:
        value, fence = finite(F.col(c).cast("double")), F.col("_fences")[c]
        missing = value.isNull()
        low, high = ranges.get(c, (None, None))
        invalid = F.lit(False) if low is None else ~value.between(F.lit(float(low)), F.lit(float(high)))
        outlying = (value < fence["low"]) | (value > fence["high"])
        flags = F.array_compact(F.array(F.when(missing, "missing_values"), F.when(~missing & invalid, "invalid_range"), F.when(~missing & F.coalesce(outlying, F.lit(False)), "outlier")))
        return F.struct(F.lit(c).alias("column"), value.alias("value"), flags.alias("flags"))

    out = marked.withColumn(CELLS, F.array(*map(cell, columns)))
    bad = F.filter(CELLS, lambda c: F.size(c["flags"]) > 0)
    names = F.transform(bad, lambda c: c["column"])
    rows = {"QC_FLAGS": joined(F.flatten(F.transform(bad, lambda c: c["flags"]))), "QC_COLUMNS": joined(names), "QC_N_FLAGS": F.size(names).cast("long")}
    return out.withColumns(rows).select(*df.columns, *rows, CELLS)


def cells(flagged: DataFrame, *keep: str) -> DataFrame:
    """A row for each cell: the kept columns, column, value and its flags."""
    return flagged.select(*keep, F.explode(CELLS).alias("c")).select(*keep, "c.*")


def status(pct: Column) -> Column:
    return F.when(pct == 0, "complete").when(pct <= 10, "low_missing").when(pct <= 25, "moderate_missing").otherwise("high_missing")


def report(flagged: DataFrame, site: str, mode: str = "row_level") -> DataFrame:
    """Counts and shares by site and column, one aggregation.

    row_level counts a flagged cell under every flag of its row, as published reports do; cell_level under its own.
    """
    if mode not in ("row_level", "cell_level"):
        raise ValueError(mode)
    own = cells(flagged, site, "QC_FLAGS")
    if mode == "row_level":
        own = own.withColumn("flags", F.when(F.size("flags") > 0, F.split("QC_FLAGS", ";")).otherwise(F.col("flags")))
    has = lambda f: F.sum(F.array_contains("flags", f).cast("long"))
    out = own.groupBy(site, "column").agg(F.count("*").alias("n_rows"), F.sum(F.col("value").isNull().cast("long")).alias("n_missing"), has("invalid_range").alias("n_invalid_range"), has("outlier").alias("n_outliers"))
    pct = lambda c: 100 * F.col(c) / F.col("n_rows")
    return out.withColumns({"missing_pct": F.bround(pct("n_missing"), 2), "invalid_range_pct": F.bround(pct("n_invalid_range"), 2), "outlier_pct": F.bround(pct("n_outliers"), 2), "column_status": status(pct("n_missing"))})


def flagged_values(flagged: DataFrame, *keys: str) -> DataFrame:
    """A row for each flagged cell with its row's keys and flags."""
    return cells(flagged, *keys, "QC_FLAGS").where(F.size("flags") > 0).select(*keys, "column", "value", "QC_FLAGS")


def pass_through(df: DataFrame) -> DataFrame:
    """The step at which values could be filled in; it records that none were."""
    return df.withColumns({"IMPUTED_COLUMNS": F.lit(""), "N_IMPUTED_VALUES": F.lit(0)})
