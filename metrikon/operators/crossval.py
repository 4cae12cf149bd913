"""Nested cross-validation of ridge models and their coefficients.

Folds are those of a shuffled k-fold over rows in key order: a permutation of the
row numbers by a seeded Mersenne twister, cut into runs. Every model comes from sums of
products by cell (outer and inner fold): a training set's sums are those of the cells it
holds, and a missing feature's fill (the training median) enters them in closed form. So
rows are aggregated once, a few hundred small systems are solved on the driver, and
predictions and inner scores are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stage
from .ranks import quantiles, running

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
#: With fewer than two inner folds there is nothing to choose from.
ALPHA = 1.0


def folds(n: int, k: int, seed: int = 42) -> np.ndarray:
    """The fold of each of n rows."""
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    sizes = np.full(k, n // k)
    sizes[: n % k] += 1
    out = np.empty(n, int)
    out[order] = np.repeat(np.arange(k), sizes)
    return out


def fold_table(spark, n: int, k: int, inner: int, seed: int) -> DataFrame:
    """(i, cv_fold, _in0, ..) for i below n: the outer fold, and for each outer fold f the inner fold among the rows not in it.

    A shuffle is one sequence, so one task makes them (a few bytes a row and fold).
    """
    k = min(k, max(n, 1))
    inner_names = [f"_in{f}" for f in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            outer = folds(n, k, seed).astype(np.int32)
            inside = []
            for f in range(k):
                rest = np.flatnonzero(outer != f)
                own = np.full(n, -1, np.int32)
                own[rest] = folds(len(rest), max(1, min(inner, len(rest))), seed)
                inside.append(own)
            for lo in range(0, n, 1 << 20):
                part = slice(lo, lo + (1 << 20))
                arrays = [pa.array(np.arange(n)[part]), pa.array(outer[part]), *(pa.array(x[part], mask=x[part] < 0) for x in inside)]
                yield pa.RecordBatch.from_arrays(arrays, ["i", "cv_fold", *inner_names])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "i long, cv_fold int" + "".join(f", {c} int" for c in inner_names))


def _dealt(df: DataFrame, key: str, k: int, inner: int, seed: int) -> tuple[DataFrame, int]:
    """(_key, cv_fold, _in0, ..) of the distinct keys, numbered in their order without one task for all of them, and how many there are."""
    numbered = running(df.select(F.col(key).alias("_key")).where("_key IS NOT NULL").distinct(), ["_key"], name="_i")
    n = numbered.count()
    table = fold_table(df.sparkSession, n, k, inner, seed)
    return numbered.join(table, F.col("_i") - 1 == F.col("i")).drop("_i", "i", "part"), n


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(.., cv_fold) of the rows that have a key."""
    dealt, _ = _dealt(df, key, k, 1, seed)
    return df.join(dealt.select("_key", "cv_fold"), F.col(key) == F.col("_key")).drop("_key")


class Sums:
    """Sums over a set of rows from which a ridge model with median fill follows; sets add and subtract."""

    def __init__(self, n: float, y: float, x: np.ndarray, absent: np.ndarray, xx: np.ndarray, xo: np.ndarray, oo: np.ndarray, xy: np.ndarray, oy: np.ndarray):
        self.all = (n, y, x, absent, xx, xo, oo, xy, oy)

    def __add__(self, other: Sums) -> Sums:
        return Sums(*(a + b for a, b in zip(self.all, other.all, strict=True)))

    def fit(self, medians: np.ndarray, alpha: float) -> Model:
        """Ridge on standardised features, missing ones filled with the medians."""
        n, sy, sx, absent, xx, xo, oo, xy, oy = self.all
        med = np.where(np.isnan(medians), 0.0, medians)
        mean, my = (sx + absent * med) / n, sy / n
        # filled products: both there, one filled, both filled
        gram = xx + xo * med[None, :] + (xo * med[None, :]).T + oo * np.outer(med, med) - n * np.outer(mean, mean)
        cross = xy + oy * med - n * mean * my
        var = np.diag(gram) / n
        sd = np.sqrt(np.where(var > 1e-12 * np.maximum(np.diag(xx) / n, 1e-300), var, 1.0))
        live = var > 1e-12 * np.maximum(np.diag(xx) / n, 1e-300)
        scale = np.outer(sd, sd)
        z = np.where(live[:, None] & live[None, :], gram / scale, 0.0)
        right = np.where(live, cross / sd, 0.0)
        system = z + alpha * np.eye(len(sd))
        coef = np.linalg.solve(system, right) if alpha > 0 else np.linalg.lstsq(system, right, rcond=None)[0]
        return Model(coef, my, med, mean, sd)


class Model:
    def __init__(self, coef: np.ndarray, mean: float, fill: np.ndarray, mu: np.ndarray, sd: np.ndarray):
        self.coef, self.mean, self.fill, self.mu, self.sd = coef, float(mean), fill, mu, sd

    def predict(self, features: list[str]) -> Column:
        out = F.lit(self.mean)
        for f, c, v, m, s in zip(features, self.coef, self.fill, self.mu, self.sd, strict=True):
            out = out + (F.coalesce(F.col(f), F.lit(float(v))) - float(m)) / float(s) * float(c)
        return out


def _sums(cell: dict, d: int) -> Sums:
    grid = lambda name: np.array([[cell[f"{name}{i}_{j}"] or 0.0 for j in range(d)] for i in range(d)], float)
    line = lambda name: np.array([cell[f"{name}{i}"] or 0.0 for i in range(d)], float)
    return Sums(float(cell["n"]), float(cell["y"] or 0.0), line("x"), line("o"), grid("xx"), grid("xo"), grid("oo"), line("xy"), line("oy"))


def _aggregates(features: list[str], truth: str, at: dict[str, float]) -> dict[str, Column]:
    """Sums by cell, features and truth less a fixed shift so that products keep their digits."""
    x = [F.col(f) - at[f] for f in features]
    o = [F.col(f).isNull().cast("double") for f in features]
    y = F.col(truth) - at[truth]
    out = {"n": F.count("*"), "y": F.sum(y)}
    for i in range(len(features)):
        out |= {f"x{i}": F.sum(x[i]), f"o{i}": F.sum(o[i]), f"xy{i}": F.sum(x[i] * y), f"oy{i}": F.sum(o[i] * y)}
        for j in range(len(features)):
            out |= {f"xx{i}_{j}": F.sum(x[i] * x[j]), f"xo{i}_{j}": F.sum(x[i] * o[j]), f"oo{i}_{j}": F.sum(o[i] * o[j])}
    return out


def _shift(df: DataFrame, names: list[str]) -> dict[str, float]:
    row = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(names))).first()
    return {c: float(row[i] or 0.0) for i, c in enumerate(names)}


def _medians(rows: DataFrame, columns: list[str], sets: list[Column]) -> dict[tuple[int, int], float]:
    """(set, column) to the median of the column's values in the rows of the set; a number for each comes to the driver."""
    inside = F.explode(F.array_compact(F.array(*(F.when(s, F.lit(i)) for i, s in enumerate(sets)))))
    cells = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.col(c).alias("v")) for j, c in enumerate(columns))))
    each = rows.select(inside.alias("i"), *columns).select("i", cells.alias("c")).select("i", "c.*")
    return {(r.i, r.j): r.q[0] for r in quantiles(each, ["i", "j"], "v", [0.5], "q").collect()}


def nested(df: DataFrame, key: str, truth: str, features: list[str], baseline: str | None = None, k: int = 5, inner: int = 4, seed: int = 42) -> DataFrame:
    """(key, truth, cv_fold, ridge_alpha, mean_model, raw_model, ols_model, ridge_model): each subject predicted by models that never saw it.

    mean_model is the training mean, raw_model the baseline feature itself, ols_model a line on it. The alpha of each
    outer fold is the first of least mean absolute error over inner folds, 1 with one training row. Rows without
    key or truth are left out; a missing feature takes the training median, which is found by ranges of counted values.
    """
    base = baseline or features[0]
    own = list(dict.fromkeys([*features, base]))
    kept = df.where(F.col(truth).isNotNull() & F.col(key).isNotNull()).select(key, F.col(truth).cast("double").alias(truth), *(F.col(f).cast("double").alias(f) for f in own))
    dealt, n = _dealt(kept, key, k, inner, seed)
    rows = stage(kept.join(dealt, F.col(key) == F.col("_key")).drop("_key"), "folds")
    outer = range(min(k, n))
    inside = {f: min(inner, n - n // len(outer) - (f < n % len(outer))) for f in outer}  # a fold holds n // k rows, the first n % k one more
    at = _shift(rows, [truth, *own])
    sets = {(f, None): F.col("cv_fold") != f for f in outer if inside[f]}
    sets |= {(f, g): (F.col("cv_fold") != f) & (F.col(f"_in{f}") != g) for f in outer if inside[f] > 1 for g in range(inside[f])}
    if not sets:
        return rows.select(key, truth, "cv_fold", *(F.lit(None).cast("double").alias(c) for c in ("ridge_alpha", "mean_model", "raw_model", "ols_model", "ridge_model")))
    # one pass: sums by cell of the outer fold's and all inner folds' numbers, and the medians of every training set
    cells = [r.asDict() for r in rows.groupBy("cv_fold", *(f"_in{f}" for f in outer)).agg(*(c.alias(n) for n, c in _aggregates(own, truth, at).items())).collect()]
    medians = _medians(rows, own, list(sets.values()))
    d, models = len(own), {}

    def total(f: int, g: int | None) -> Sums:
        mine = [_sums(c, d) for c in cells if c["cv_fold"] != f and (g is None or c[f"_in{f}"] != g)]
        out = mine[0]
        for m in mine[1:]:
            out = out + m
        return out

    pick = [own.index(f) for f in features]
    for i, (f, g) in enumerate(sets):
        sums = total(f, g)
        fill = np.array([np.nan if (v := medians.get((i, j))) is None else v - at[own[j]] for j in range(d)])
        one = lambda which, s=sums: Sums(*(a if np.ndim(a) == 0 else a[which] if np.ndim(a) == 1 else a[np.ix_(which, which)] for a in s.all))
        models[f, g] = {a: one(pick).fit(fill[pick], a) for a in ALPHAS} | {"ols": one([own.index(base)]).fit(fill[[own.index(base)]], 0.0), "mean": sums.all[1] / sums.all[0]}
    moved = rows.withColumns({c: F.col(c) - at[c] for c in own})
    error = lambda f, g, a: F.avg(F.when((F.col("cv_fold") != f) & (F.col(f"_in{f}") == g), F.abs(models[f, g][a].predict(features) + at[truth] - F.col(truth))))
    tried = [(f, g, a) for f in outer if inside[f] > 1 for g in range(inside[f]) for a in ALPHAS]
    scores = moved.agg(*(error(*t).alias(f"s{i}") for i, t in enumerate(tried))).first() if tried else []
    by = {t: scores[i] for i, t in enumerate(tried)}
    best = {f: ALPHAS[int(np.argmin([np.mean([by[f, g, a] for g in range(inside[f])]) for a in ALPHAS]))] if inside[f] > 1 else ALPHA for f in outer}
    of = lambda make: F.coalesce(*(F.when(F.col("cv_fold") == f, make(f)) for f in outer if (f, None) in models))
    out = moved.select(
        key, truth, "cv_fold", of(lambda f: F.lit(float(best[f]))).alias("ridge_alpha"), of(lambda f: F.lit(float(models[f, None]["mean"]) + at[truth])).alias("mean_model"), (F.col(base) + at[base]).alias("raw_model"),
        of(lambda f: models[f, None]["ols"].predict([base]) + at[truth]).alias("ols_model"), of(lambda f: models[f, None][best[f]].predict(features) + at[truth]).alias("ridge_model"),
    )
    return out


def coefficients(df: DataFrame, key: str, truth: str, features: list[str], alpha: float) -> DataFrame:
    """(feature, alpha, coefficient_standardised, coefficient_original_units, intercept_original_units) of the model on all subjects; no rows without any."""
    kept = df.where(F.col(truth).isNotNull()).select(F.col(truth).cast("double").alias(truth), *(F.col(f).cast("double").alias(f) for f in features))
    at = _shift(kept, [truth, *features])
    row = kept.agg(*(c.alias(n) for n, c in _aggregates(features, truth, at).items())).first().asDict()
    schema = "feature string, alpha double, coefficient_standardised double, coefficient_original_units double, intercept_original_units double"
    if not row["n"]:
        return df.sparkSession.createDataFrame([], schema)
    medians = _medians(kept, features, [F.lit(True)])
    fill = np.array([np.nan if (v := medians.get((0, i))) is None else v - at[f] for i, f in enumerate(features)])
    m = _sums(row, len(features)).fit(fill, alpha)
    own = m.coef / m.sd
    intercept = m.mean + at[truth] - float(own @ (m.mu + np.array([at[f] for f in features])))
    return df.sparkSession.createDataFrame([(f, float(alpha), float(c), float(o), intercept) for f, c, o in zip(features, m.coef, own, strict=True)], schema)


def median_alpha(predictions: DataFrame, alpha: str = "ridge_alpha") -> float:
    """The median of the alphas of the predictions, 1 without any."""
    found = predictions.agg(F.median(alpha)).first()[0]
    return ALPHA if found is None else float(found)
