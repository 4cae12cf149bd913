"""Schema mapping of sites' tables to one canonical table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import ponderal
from ..functions.nulls import number, row_mean


@dataclass(frozen=True)
class Mapping:
    """How a site's columns become canonical: target to source name, scale factors, means of several, constants."""

    columns: dict[str, str] = field(default_factory=dict)
    factors: dict[str, float] = field(default_factory=dict)
    means: dict[str, tuple[str, ...]] = field(default_factory=dict)
    constants: dict[str, str] = field(default_factory=dict)
    text: tuple[str, ...] = ("ID", "TYPE")


def equalise(df: DataFrame, spec: Mapping, order: list[str]) -> DataFrame:
    """The canonical columns in order; texts that are no numbers and columns the site lacks are null."""
    names = {c.strip(): c for c in df.columns}
    df = df.select(*(F.col(f"`{old}`").alias(new) for new, old in names.items()))
    needed = {s for t, s in spec.columns.items() if t not in spec.text} | {s for m in spec.means.values() for s in m}
    df = df.withColumns({c: number(F.col(f"`{c}`").cast("string")) for c in needed if c in df.columns})

    def make(target: str) -> Column:
        if target in spec.constants:
            return F.lit(spec.constants[target])
        if target in spec.means:
            return row_mean(*(f"`{c}`" for c in spec.means[target]))
        if target in spec.columns:
            return F.col(f"`{spec.columns[target]}`") * spec.factors.get(target, 1.0) if target not in spec.text else F.col(f"`{spec.columns[target]}`").cast("string")
        return F.lit(None).cast("string" if target in spec.text else "double")

    out = df.select(*(make(t).alias(t) for t in order if t != "PONDERAL_INDEX_kg_m3"))
    if "PONDERAL_INDEX_kg_m3" in order:
        out = out.withColumn("PONDERAL_INDEX_kg_m3", ponderal(F.col("WEIGHT_kg"), F.col("HEIGHT_cm")))
    return out.select(*order)


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
