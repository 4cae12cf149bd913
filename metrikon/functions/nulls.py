"""Null discipline. NaN and infinities become null once, at the boundary; nothing below sees them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clean(df: DataFrame) -> DataFrame:
    """The boundary rule for every floating column."""
    return df.withColumns({f.name: finite(F.col(f.name).cast("double")) for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))})


def number(c: Column | str) -> Column:
    """Text to double; what does not parse is null."""
    return finite(F.trim(F.col(c) if isinstance(c, str) else c).try_cast("double"))


def row_mean(*columns: str) -> Column:
    """Mean over a row's non-null cells; null if there are none."""
    cells = [F.col(c).cast("double") for c in columns]
    n = sum((c.isNotNull().cast("int") for c in cells[1:]), cells[0].isNotNull().cast("int"))
    return sum((F.coalesce(c, F.lit(0.0)) for c in cells[1:]), F.coalesce(cells[0], F.lit(0.0))) / F.nullif(n, F.lit(0))


def ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """a / b; null where abs(b) is at most least."""
    return F.when(F.abs(b) > least, a / b)


def optional(df: DataFrame, name: str, kind: str = "double") -> Column:
    """The column, or nulls if the frame lacks it."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def clamp(c: Column, low: Column, high: Column) -> Column:
    """Clamped value; null if any part is, as least() and greatest() skip nulls."""
    return F.when(c.isNotNull() & low.isNotNull() & high.isNotNull(), F.least(F.greatest(c, low), high))


def joined(c: Column) -> Column:
    """A set as its sorted, ;-joined string."""
    return F.array_join(F.array_sort(F.array_distinct(c)), ";")


def report(c: Column, digits: int) -> Column:
    """Rounded half to even, as reports are."""
    return F.bround(c, digits)
