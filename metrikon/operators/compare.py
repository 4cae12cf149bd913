"""The comparison of estimators by image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pseudonym import require_unique


def outer(frames: dict[str, DataFrame], on: str) -> DataFrame:
    """Full outer join one to one on a key; a duplicate key fails the query. Columns are prefixed by their frame's name."""
    return outer_on([df.select(on, *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c != on)) for name, df in frames.items()], on)


def outer_on(frames: list[DataFrame], on: str) -> DataFrame:
    """The same for frames whose columns have names of their own already.

    A null key is a key: the rows without one meet each other, and a frame may have one of them. A key of one frame has one row, so a
    shuffle by the key is balanced.
    """
    out = require_unique(frames[0], [on])
    for df in frames[1:]:
        right = require_unique(df, [on]).withColumnRenamed(on, "_on")
        out = out.join(right, F.col(on).eqNullSafe(F.col("_on")), "full_outer").select(F.coalesce(on, "_on").alias(on), *(c for c in out.columns if c != on), *(c for c in df.columns if c != on))
    return out


def ids_first(df: DataFrame, ids: list[str]) -> DataFrame:
    """The columns with those of ids that the frame has first, the others in their order."""
    return df.select(*(c for c in ids if c in df.columns), *(c for c in df.columns if c not in ids))


def equivalent_scale(height_cm: Column, height_px: Column) -> Column:
    """Centimetres a pixel; null without pixels."""
    return height_cm / F.nullif(height_px, F.lit(0))


def matrix_wide(matrix: DataFrame, groups: list[str], metric: str = "mae", digits: int = 4) -> DataFrame:
    """Methods as rows, groups as columns."""
    return matrix.groupBy("method").pivot("grp", groups).agg(F.bround(F.first(metric), digits))
