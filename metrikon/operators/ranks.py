"""Positions, running totals and order statistics over whole tables and hot groups, without one task for all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import stage


def running(df: DataFrame, order: list[str], weight: str | None = None, name: str = "upto", part: str = "part") -> DataFrame:
    """df with the running total of weight (a whole number; by default the row's number, from 1) in the order, and the part it lies in.

    Rows are dealt by ranges of the order, and each part is summed as it is read in its order and stored once; the parts'
    totals, one row each, are added up. Rows equal in the order may come either way round. A null weight counts as 0.
    """
    taken = {c.lower() for c in df.columns}
    inside = next(c for c in ("_inside", "_inside_", "_inside__") if c not in taken)
    schema = StructType(list(df.schema)).add(part, "integer").add(inside, "long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = 0, TaskContext.get().partitionId()
        for b in batches:
            w = np.ones(b.num_rows, np.int64) if weight is None else b.column(weight).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = total + np.cumsum(w)
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, own, np.int32)), pa.array(sums)], schema=arrow)

    dealt = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "ranges")
    totals = dealt.groupBy(part).agg((F.sum(weight) if weight else F.count("*")).alias("_total"))
    before = F.sum("_total").over(Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(F.col(part).alias("_part"), F.coalesce(before, F.lit(0)).alias("_before"))
    return dealt.join(offsets, F.col(part) == F.col("_part")).withColumn(name, F.col(inside) + F.col("_before")).drop(inside, "_part", "_before")


def median(df: DataFrame, value: str, name: str = "median") -> DataFrame:
    """One row with the exact median of a column, null without values; from counts of distinct values by ranges, so no task holds all of them."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    upto = running(counts, ["v"], "c", "g")
    n = upto.agg(F.sum("c").alias("n"))
    middle = upto.crossJoin(F.broadcast(n)).where((F.col("g") >= F.floor((F.col("n") + 1) / 2)) & (F.col("g") - F.col("c") < F.floor((F.col("n") + 2) / 2)))  # one row of n
    # the value or two values that hold the middle places
    return middle.agg((F.min("v") + (F.max("v") - F.min("v")) / 2).alias(name))


def quantiles(df: DataFrame, groups: list[str], value: str, shares: list[float], name: str = "quantiles", count: str = "n") -> DataFrame:
    """(groups, n, quantiles): of each group with values how many there are, and the exact quantiles with linear interpolation, as an array.

    Counts of distinct values stand for rows. They are dealt by ranges of group and value, so that a hot group lies in many tasks, and are
    numbered by running totals; a group's place in each range is a row, and only the values that hold an asked place are brought together. Null groups are groups.
    """
    names = [f"_g{i}" for i in range(len(groups))]
    counts = df.where(F.col(value).isNotNull()).groupBy(*(F.col(g).alias(n) for g, n in zip(groups, names, strict=True)), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    upto = running(counts, [*names, "_v"], "_c", "_upto", "_range")
    own = Window.partitionBy(*names)
    ranges = upto.groupBy("_range", *names).agg(F.min(F.col("_upto") - F.col("_c")).alias("_first"), F.sum("_c").alias("_m"))
    ranges = ranges.select(F.col("_range").alias("_p"), *(F.col(n).alias(f"{n}_") for n in names), F.min("_first").over(own).alias("_base"), F.sum("_m").over(own).alias("_n"))
    same = [F.col("_range") == F.col("_p"), *(F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names)]
    rows = upto.join(ranges, same).select(*names, "_v", "_n", (F.col("_upto") - F.col("_base")).alias("_to"), (F.col("_upto") - F.col("_base") - F.col("_c")).alias("_from"))
    places = [s * (F.col("_n") - 1) for s in shares]  # from 0
    holds = lambda k: (F.col("_from") <= k) & (k < F.col("_to"))
    asked = [(F.floor(p), F.ceil(p)) for p in places]
    some = F.lit(False)
    for low, high in asked:
        some = some | holds(low) | holds(high)
    found = rows.where(some).groupBy(*names).agg(F.first("_n").alias("_n"), *(F.max(F.when(holds(k), F.col("_v"))).alias(f"_{side}{i}") for i, pair in enumerate(asked) for side, k in zip("lh", pair, strict=True)))
    between = [F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (p - F.floor(p)) for i, p in enumerate(places)]
    return found.select(*(F.col(n).alias(g) for g, n in zip(groups, names, strict=True)), F.col("_n").alias(count), F.array(*between).alias(name))
