"""Stateless quality flags on a stream, against bounds fixed before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import qc


def flag_stream(stream: DataFrame, site: str, key: str, columns: list[str], ranges: dict[str, tuple[float, float]], bounds: DataFrame) -> DataFrame:
    """A row for each cell that has a flag. bounds is a static frame as iqr_bounds gives it, so no state is kept."""
    flagged = qc.flag(stream, site, columns, ranges, bounds)
    return qc.cells(flagged, site, key).where(F.size("flags") > 0)
