"""Stratified nearest-neighbour imputation and its leave-one-value-out validation.

Rows are compared within their stratum only, and a row is itself by its place, not by its key. Rows that lie near each other
form blocks of a bounded number of rows with a bounding box each. A block is first compared with the blocks whose boxes
are nearest, which bounds how far its k nearest donors can be; of the others it meets those whose boxes
may hold a nearer one, whatever values are missing. Blocks of donors lie together in one task and the blocks that ask pass by
them, so pairs of rows are neither stored nor shuffled, a hot stratum is many tasks, and the result is that of comparing all pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import stage

#: Rows of a block; blocks cut from one slab of rows; blocks of donors that lie in one task.
BLOCK, SLAB, TOGETHER = 1024, 16, 16
#: Blocks whose boxes are compared at once.
CHUNK = 64
#: Rows of a tile of the whole matrix at least and at most; the meetings of tiles beyond which tiles grow, the tasks these are dealt to at most, and columns in a word.
TILE, HELD, MEETINGS, TASKS, WORD = 2048, 65_536, 128, 10_000, 62


def zscores(df: DataFrame, strata: list[str], columns: list[str], prefix: str = "z_") -> DataFrame:
    """Standardised columns by stratum (population deviation); null for constant ones."""
    names = {c: f"_k{i}" for i, c in enumerate(strata)}
    moments = df.groupBy(*(F.col(c).alias(names[c]) for c in strata)).agg(*(f(F.col(c)).alias(f"_{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.join(moments, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left")
    return out.withColumns({prefix + c: (F.col(c) - F.col(f"_m{i}")) / F.nullif(F.col(f"_s{i}"), F.lit(0.0)) for i, c in enumerate(columns)}).select(*df.columns, *(prefix + c for c in columns))


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """The rows, stored, each with a number of its own."""
    return stage(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def nan_distance(df: DataFrame, strata: list[str], key: str, columns: list[str], tile: int = TILE) -> DataFrame:
    """(strata, key, donor, distance) of every ordered pair of rows of a stratum: the whole matrix, which is what it is for; imputation does not need it.

    Strata are dealt into tiles and every two tiles of a stratum meet under a key of their own, so that a hot stratum is many tasks. Tiles have about tile rows at least and grow with
    the table, up to HELD rows: until then neither the number of meetings grows nor how often a row is sent, and a task's memory is that of some tiles.
    """
    z = numbered(zscores(df.select(*strata, key, *columns), strata, columns).where(~_any_null(strata)))
    names = {c: f"_k{i}" for i, c in enumerate(strata)}
    sizes = z.groupBy(*(F.col(c).alias(names[c]) for c in strata)).agg(F.count("*").alias("_n"))
    # two numbers come to the driver
    n = F.col("_n").cast("double")
    pairs, rows = (x or 0.0 for x in sizes.agg(F.sum(n * n), F.sum(n)).first())
    size = min(HELD, max(tile, math.sqrt(pairs / MEETINGS)))
    tasks = max(1, min(TASKS, math.ceil(pairs / size / size + rows / size / TOGETHER)))
    dealt = z.join(sizes, [F.col(c) == F.col(k) for c, k in names.items()]).withColumn("_tiles", F.ceil(F.col("_n") / size))
    dealt = dealt.withColumn("_tile", F.pmod(F.xxhash64("_row"), F.col("_tiles"))).withColumn("_met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)))
    # which columns a row has is one word for each WORD of them, and missing ones are 0, so that a pair takes few steps
    words = [list(range(i, min(i + WORD, len(columns)))) for i in range(0, len(columns), WORD)]
    have = [sum((F.when(F.col("z_" + columns[i]).isNotNull(), F.lit(1 << i - w[0])).otherwise(F.lit(0)).cast("long") for i in w), F.lit(0).cast("long")) for w in words]
    cells = lambda p, h: [*(F.coalesce("z_" + c, F.lit(0.0)).alias(f"{p}{i}") for i, c in enumerate(columns)), *(x.alias(f"{h}{i}") for i, x in enumerate(have))]
    mine = dealt.select(*strata, key, "_row", F.col("_tile").alias("_a"), F.col("_met").alias("_b"), *cells("_z", "_h"))
    other = dealt.select(*strata, F.col(key).alias("donor"), F.col("_row").alias("_other"), F.col("_met").alias("_a"), F.col("_tile").alias("_b"), *cells("_d", "_g"))
    on = [*strata, "_a", "_b"]
    pairs = mine.repartition(tasks, *on).join(other.repartition(tasks, *on).hint("merge"), on).where(F.col("_row") != F.col("_other"))
    both = [F.col(f"_h{i}").bitwiseAND(F.col(f"_g{i}")) for i in range(len(words))]
    gap = lambda i: F.col(f"_z{i}") - F.col(f"_d{i}")
    terms = [F.when(both[i // WORD].bitwiseAND(F.lit(1 << i % WORD).cast("long")) != 0, gap(i) * gap(i)).otherwise(0.0) for i in range(len(columns))]
    total, m = sum(terms, F.lit(0.0)), sum((F.bit_count(x) for x in both), F.lit(0))
    return pairs.select(*strata, key, "donor", F.when(m > 0, F.sqrt(len(columns) / m * total)).alias("distance"))


def pearson(a: str, b: str) -> Column:
    """Correlation over the rows that have both columns, an aggregate; null where one of them is constant (corr fails there in ANSI mode)."""
    spread = lambda x, y: F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x)))
    return F.covar_pop(a, b) / F.nullif(spread(a, b) * spread(b, a), F.lit(0.0))


def column_sets(df: DataFrame, strata: list[str], columns: list[str], within: list[str] | None = None, limit: float | None = None) -> DataFrame:
    """(strata, used): for each stratum which of the columns measure distance, an array of booleans.

    Columns without any value in the rows of equal within are left out; with limit also those whose correlation in the stratum
    with a column kept before exceeds it in absolute value. A correlation that is undefined keeps its column.
    """
    d = len(columns)
    pairs = [(i, j) for j in range(d) for i in range(j)] if limit is not None else []
    r = df.groupBy(*strata).agg(F.count("*").alias("_n"), *(F.abs(pearson(columns[i], columns[j])).alias(f"_r{i}_{j}") for i, j in pairs))
    # the walk from left to right: a column stays unless it is too near to one that stays
    near = F.array(*(F.array(*(F.coalesce(F.col(f"_r{i}_{j}") > limit, F.lit(False)) for i in range(j)), F.lit(False)) for j in range(d))) if pairs else F.array(*(F.array(F.lit(False)) for _ in range(d)))
    keep = F.aggregate("_near", F.array().cast("array<boolean>"), lambda kept, row: F.concat(kept, F.array(~F.exists(F.zip_with(kept, row, lambda k, x: k & F.coalesce(x, F.lit(False))), lambda x: F.coalesce(x, F.lit(False))))))
    out = r.withColumn("_near", near).select(*strata, keep.alias("used"))
    if within:
        live = df.groupBy(*(F.col(c).alias(f"_w{i}") for i, c in enumerate(within))).agg(F.array(*(F.count(F.col(c)) > 0 for c in columns)).alias("_live"))
        out = out.join(live, [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(within)]).select(*strata, F.zip_with("used", "_live", lambda a, b: a & b).alias("used"))
    return out


def _prepared(df: DataFrame, strata: list[str], key: str, columns: list[str], targets: list[str], row: str | None, sets: DataFrame) -> DataFrame:
    """(_s0, .., _key, _row, z, v, d, u): standardised distance columns (null where not used), targets' values, how many columns are used, and the mean of z."""
    names = [f"_s{i}" for i in range(len(strata))]
    z = zscores(df, strata, columns)
    chosen = sets.select(*(F.col(c).alias(n) for c, n in zip(strata, names, strict=True)), "used")
    z = z.where(~_any_null(strata)).join(chosen, [F.col(c) == F.col(n) for c, n in zip(strata, names, strict=True)])
    cells = F.array(*(F.when(F.col("used")[i], F.col("z_" + c)) for i, c in enumerate(columns)))
    number = F.col(row) if row else F.monotonically_increasing_id()
    out = z.select(*names, F.col(key).alias("_key"), number.alias("_row"), cells.alias("z"), F.array(*(F.col(c).cast("double") for c in targets)).alias("v"), F.size(F.filter("used", lambda x: x)).cast("long").alias("d"))
    there = F.array_compact("z")
    return out.withColumn("u", F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(there), F.lit(0)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _split(z: np.ndarray, rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Rows in halves by the median of the widest column until they fit; a missing value lies far from all others, so patterns of missing ones part first."""
    if len(rows) <= size:
        yield rows
        return
    own = np.where(np.isnan(z[rows]), -9.0, z[rows])
    half = -(-len(rows) // 2 // size) * size if len(rows) > 2 * size else len(rows) // 2
    order = np.argsort(own[:, own.var(0).argmax()] if own.shape[1] else np.zeros(len(rows)), kind="stable")
    yield from _split(z, rows[order[:half]], size)
    yield from _split(z, rows[order[half:]], size)


def _blocks(rows: DataFrame, d: int, n_targets: int, size: int, hidden: bool) -> DataFrame:
    """One stored row for each block: its rows by key, their vectors end to end, its box, and for each target how many rows have it and how many ask for it.

    Rows come in the order of their stratum and mean; each slab of some blocks' rows is cut along its widest columns.
    """
    names = [c for c in rows.columns if c.startswith("_s")]
    kinds = {f.name: f.dataType for f in rows.schema}
    lists = {"keys": kinds["_key"], "rows": T.LongType(), "z": T.DoubleType(), "v": T.DoubleType(), "low": T.DoubleType(), "high": T.DoubleType(), "always": T.BooleanType(), "gives": T.LongType(), "asks": T.LongType()}
    schema = rows.select(*names).schema.add("_b", "long").add("d", "long")
    for name, kind in lists.items():
        schema = schema.add(name, T.ArrayType(kind))
    arrow = to_arrow_schema(schema)

    def pack(t: pa.Table, numbers: Iterator[int]) -> Iterator[pa.RecordBatch]:
        z = _matrix(t["z"], d)
        for part in _split(z, np.arange(t.num_rows), size):
            own = t.take(pa.array(part))
            own = own.take(pc.sort_indices(own, sort_keys=[("_key", "ascending"), ("_row", "ascending")], null_placement="at_start"))
            mine, values = _matrix(own["z"], d), _matrix(own["v"], n_targets)
            there, given = ~np.isnan(mine), (~np.isnan(values)).sum(0)
            row = {n: own[n][0].as_py() for n in (*names, "d")} | {"_b": next(numbers), "keys": own["_key"].to_pylist(), "rows": own["_row"].to_pylist()}
            row |= {"z": [None if np.isnan(x) else x for x in mine.ravel().tolist()], "v": [None if np.isnan(x) else x for x in values.ravel().tolist()]}
            low, high = np.where(there, mine, np.inf).min(0), np.where(there, mine, -np.inf).max(0)
            row |= {"low": low.tolist(), "high": high.tolist(), "always": there.all(0).tolist(), "gives": given.tolist(), "asks": (given if hidden else len(values) - given).tolist()}
            yield pa.RecordBatch.from_pylist([row], arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        held: list[pa.Table] = []
        for b in batches:
            t = pa.Table.from_batches([b])
            # where the stratum changes
            edges = [0, *(i for i in range(1, len(t)) if any(t[n][i] != t[n][i - 1] for n in names)), len(t)] if len(t) and any(pc.count_distinct(t[n]).as_py() > 1 for n in names) else [0, len(t)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                piece = t.slice(lo, hi - lo)
                if not piece.num_rows:
                    continue
                if held and any(held[0][n][0] != piece[n][0] for n in names):
                    yield from pack(pa.concat_tables(held), numbers)
                    held = []
                held.append(piece)
                while sum(map(len, held)) >= SLAB * size:
                    whole = pa.concat_tables(held)
                    yield from pack(whole.slice(0, SLAB * size), numbers)
                    held = [whole.slice(SLAB * size)] if whole.num_rows > SLAB * size else []
        if held:
            yield from pack(pa.concat_tables(held), numbers)

    order = [*names, "u", "_row"]
    return stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "knn-blocks")


class Boxes:
    """Some blocks of a stratum, as bounds of their rows' columns."""

    def __init__(self, row: dict, side: str, d: int):
        of = lambda name: np.array([b[name] for b in row[side]])
        self.ids, self.low, self.high, self.always, self.gives, self.asks = of("_b"), of("low").reshape(-1, d), of("high").reshape(-1, d), of("always").reshape(-1, d), of("gives"), of("asks")
        self.d = int(row[side][0]["d"])

    def bounds(self, other: Boxes, without: int | None) -> np.ndarray:
        """The least distance that a row of each block here can have to a row of each block there, whichever columns they share; infinite if they share none."""
        gap = np.maximum(np.maximum(other.low[None] - self.high[:, None], self.low[:, None] - other.high[None]), 0.0)
        shared = np.isfinite(self.low)[:, None] & np.isfinite(other.low)[None]
        must = self.always[:, None] & other.always[None]
        if without is not None:
            shared[:, :, without] = must[:, :, without] = False
        square = np.where(shared, gap, 0.0) ** 2
        # the columns that every pair shares, then of those that a pair may share the nearest first
        total, n = np.where(must, square, 0.0).sum(2), must.sum(2).astype(float)
        least = np.divide(total, n, out=np.full(total.shape, np.inf), where=n > 0)
        for x in np.moveaxis(np.sort(np.where(shared & ~must, square, np.inf), axis=2), 2, 0):
            total, n = total + x, n + 1
            least = np.minimum(least, total / n)
        return np.sqrt(self.d * least) * (1 - 1e-9)

    def apart(self, other: Boxes) -> np.ndarray:
        """Distance of the boxes' middles over the columns both have; it orders blocks, no more."""
        with np.errstate(invalid="ignore"):
            x = (self.low + self.high)[:, None] / 2 - (other.low + other.high)[None] / 2
        return np.sqrt(np.where(np.isfinite(x), x, 0.0) ** 2).sum(2)


class _Search:
    """The k nearest donors in blocks, for one table."""

    def __init__(self, df: DataFrame, strata: list[str], key: str, columns: list[str], targets: list[str], k: int, hidden: bool, block: int, row: str | None, within: list[str] | None, limit: float | None):
        self.strata, self.key, self.targets, self.k, self.hidden, self.width = strata, key, targets, k, hidden, len(columns)
        self.at = [columns.index(c) if c in columns else None for c in targets]
        rows = _prepared(df, strata, key, columns, targets, row, column_sets(df, strata, columns, within, limit))
        self.names = [c for c in rows.columns if c.startswith("_s")]
        self.types = df.select(*strata, key).schema
        self.blocks = _blocks(rows, self.width, len(targets), block, hidden)
        box = F.struct("_b", "d", "low", "high", "always", "gives", "asks")
        self.chunks = self.blocks.groupBy(*self.names, F.shiftright("_b", CHUNK.bit_length() - 1).alias("_chunk")).agg(F.collect_list(box).alias("mine"))

    def _chunk_pairs(self, mine: DataFrame) -> DataFrame:
        other = self.chunks.select(*self.names, F.col("mine").alias("other"))
        return mine.join(other, self.names)

    def first(self) -> DataFrame:
        """(a, b): for each block and target the nearest block with enough donors."""
        d, k, at, hidden = self.width, self.k, self.at, self.hidden

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    mine, other = Boxes(row, "mine", d), Boxes(row, "other", d)
                    apart, out = mine.apart(other), []
                    for t, c in enumerate(at):
                        lb = mine.bounds(other, c if hidden else None)
                        near = np.where((other.gives[None, :, t] > k) & np.isfinite(lb), lb * 1e6 + apart, np.inf)
                        best = near.argmin(1)
                        rows = np.arange(len(mine.ids))
                        good = np.isfinite(near[rows, best]) & (mine.asks[:, t] > 0)
                        out += [pa.RecordBatch.from_arrays([pa.array(mine.ids[good]), pa.array(np.full(good.sum(), t)), pa.array(near[rows, best][good]), pa.array(other.ids[best][good])], ["a", "t", "far", "b"])]
                    yield from out

        found = self._chunk_pairs(self.chunks).select("mine", "other").mapInArrow(run, "a long, t long, far double, b long")
        return found.groupBy("a", "t").agg(F.min(F.struct("far", "b")).alias("m")).select("a", F.col("m.b").alias("b")).distinct()

    def rest(self, radii: DataFrame, done: DataFrame) -> DataFrame:
        """(a, b): the other blocks that may hold a donor nearer than the k found first. radii: (a, radii) by target, infinite where fewer were found."""
        d, at, hidden = self.width, self.at, self.hidden

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    mine, other = Boxes(row, "mine", d), Boxes(row, "other", d)
                    radius = np.array([[np.inf if x is None else x for x in r] if r else [np.inf] * len(at) for r in row["radii"]])
                    wanted = np.zeros((len(mine.ids), len(other.ids)), bool)
                    for t, c in enumerate(at):
                        lb = mine.bounds(other, c if hidden else None)
                        wanted |= (lb <= radius[:, t, None]) & np.isfinite(lb) & (mine.asks[:, t, None] > 0) & (other.gives[None, :, t] > 0)
                    a, b = np.nonzero(wanted)
                    yield pa.RecordBatch.from_arrays([pa.array(mine.ids[a]), pa.array(other.ids[b])], ["a", "b"])

        box = self.blocks.join(radii, F.col("_b") == F.col("a"), "left")
        pair = F.struct(F.struct("_b", "d", "low", "high", "always", "gives", "asks").alias("box"), "radii")
        mine = box.groupBy(*self.names, F.shiftright("_b", CHUNK.bit_length() - 1).alias("_chunk")).agg(F.collect_list(pair).alias("p"))
        mine = mine.select(*self.names, F.col("p.box").alias("mine"), F.col("p.radii").alias("radii"))
        found = self._chunk_pairs(mine).select("mine", "radii", "other").mapInArrow(run, "a long, b long")
        return found.join(done, ["a", "b"], "left_anti")

    def meet(self, pairs: DataFrame) -> DataFrame:
        """(strata, key, _row, _a, column, own, given, distance, donor, _donor): for each cell asked for its k nearest donors in the blocks that its own is paired with, by tasks.

        A task holds the donors of some neighbouring blocks; blocks that ask pass by one after the other.
        """
        shift = TOGETHER.bit_length() - 1
        asked = pairs.groupBy("a", F.shiftright("b", shift).alias("_g")).agg(F.collect_list("b").alias("with"))
        data = ["keys", "rows", "z", "v", "d"]
        askers = asked.join(self.blocks, F.col("a") == F.col("_b")).select("_g", F.col("a").alias("_b"), *self.names, *data, "with")
        donors = self.blocks.select(F.shiftright("_b", shift).alias("_g"), "_b", *self.names, *data, F.lit(None).cast("array<long>").alias("with"))
        line = donors.unionByName(askers).withColumn("_asks", F.col("with").isNotNull()).repartition("_g").sortWithinPartitions("_g", "_asks", "_b")
        kinds = {f.name: f for f in self.blocks.schema}
        schema = T.StructType(list(self.types)).add("_row", "long").add("_a", "long").add("column", "string").add("own", "double").add("given", "double").add("distance", "double").add("donor", kinds["keys"].dataType.elementType).add("_donor", "long")
        arrow, d, targets, at, k, hidden, names = to_arrow_schema(schema), self.width, self.targets, self.at, self.k, self.hidden, self.names

        def compare(mine: dict, donors: list[dict]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple]] = {}
            for other in donors:
                z, dz = mine["z"], other["z"]
                s, m = np.zeros((len(z), len(dz))), np.zeros((len(z), len(dz)), np.int32)
                for c in range(d):
                    t = z[:, c, None] - dz[None, :, c]
                    t *= t
                    here = ~np.isnan(t)
                    s += np.where(here, t, 0.0)
                    m += here
                for x, c in enumerate(at):
                    ask = np.flatnonzero(~np.isnan(mine["v"][:, x]) if hidden else np.isnan(mine["v"][:, x]))
                    give = np.flatnonzero(~np.isnan(other["v"][:, x]))
                    if not len(ask) or not len(give):
                        continue
                    part, n = s[np.ix_(ask, give)], m[np.ix_(ask, give)]
                    if hidden and c is not None:
                        t = z[ask, c, None] - dz[None, give, c]
                        t *= t
                        here = ~np.isnan(t)
                        part, n = np.maximum(part - np.where(here, t, 0.0), 0.0), n - here
                    with np.errstate(all="ignore"):
                        distance = np.where(n > 0, np.sqrt(mine["d"] / n * part), np.inf)
                    if mine["_b"] == other["_b"]:
                        distance[ask[:, None] == give[None, :]] = np.inf  # a row is no donor of its own
                    row, donor = _nearest(distance, k)
                    best.setdefault(x, []).append((ask[row], distance[row, donor], other["keys"].take(pa.array(give[donor])), other["rows"][give[donor]], other["v"][give[donor], x]))
            for x, found in best.items():
                row, distance, keys, numbers, given = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), pa.concat_arrays([f[2] for f in found]), np.concatenate([f[3] for f in found]), np.concatenate([f[4] for f in found])
                place = pc.sort_indices(pa.table({"row": row, "distance": distance, "key": keys, "number": numbers}), sort_keys=[(c, "ascending") for c in ("row", "distance", "key", "number")], null_placement="at_start").to_numpy()
                row = row[place]
                kept = place[np.arange(len(row)) - np.searchsorted(row, row) < k]
                row = np.concatenate([f[0] for f in found])[kept]
                out = [pa.array([mine[n]] * len(row), arrow.field(i).type) for i, n in enumerate(names)]
                out += [mine["keys"].take(pa.array(row)), pa.array(mine["rows"][row]), pa.array(np.full(len(row), mine["_b"])), pa.array([targets[x]] * len(row)), pa.array(mine["v"][row, x], from_pandas=True), pa.array(given[kept]), pa.array(distance[kept]), keys.take(pa.array(kept)), pa.array(numbers[kept])]
                yield pa.RecordBatch.from_arrays(out, schema=arrow)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, dict] = {}
            group = None
            for b in batches:
                for i in range(b.num_rows):
                    own = {c: b.column(c)[i].as_py() for c in ("_g", "_b", "with", "d", *names)}
                    own |= {"keys": b.column("keys")[i].values, "rows": b.column("rows")[i].values.to_numpy(), "z": _matrix(b.column("z").slice(i, 1), d), "v": _matrix(b.column("v").slice(i, 1), len(targets))}
                    if own["_g"] != group:
                        group, held = own["_g"], {}
                    if own["with"] is None:
                        held[own["_b"]] = own
                    else:
                        yield from compare(own, [held[x] for x in sorted(own["with"])])

        return line.mapInArrow(run, schema)

    def donors(self) -> DataFrame:
        """Of each target cell asked for its k nearest donors at least, each once."""
        first = self.first()
        near = stage(self.meet(first), "knn-near")
        order = Window.partitionBy("_row", "column").orderBy("distance", "donor", "_donor")
        ranked = near.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= self.k)
        cells = ranked.groupBy("_a", "column", "_row").agg(F.when(F.count("*") == self.k, F.max("distance")).alias("far"))
        full = cells.groupBy(F.col("_a").alias("a"), "column").agg(F.count("*").alias("n"), F.when(F.count("far") == F.count("*"), F.max("far")).alias("far"))
        # a cell without any donor yet has no line here, so a block's radius needs one for each cell that asks
        asks = self.blocks.select(F.col("_b").alias("a"), F.posexplode("asks").alias("t", "asks")).withColumn("column", F.array(*map(F.lit, self.targets))[F.col("t")])
        full = asks.join(full, ["a", "column"], "left").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("t", F.when(F.col("n") == F.col("asks"), F.col("far")).alias("far")))).alias("r"))
        rest = self.rest(full.select("a", F.col("r.far").alias("radii")), first)
        self.pairs = rest.unionByName(first)
        return near.unionByName(self.meet(rest))

    def compared(self) -> DataFrame:
        """(pairs, all): how many pairs of rows donors() compares, and how many there are within strata."""
        size = self.blocks.select("_b", F.size("rows").alias("n"))
        met = self.pairs.join(size.select(F.col("_b").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("_b").alias("b"), F.col("n").alias("nb")), "b").agg(F.sum(F.col("na") * F.col("nb")).alias("pairs"))
        every = self.blocks.groupBy(*self.names).agg(F.sum(F.size("rows")).alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("all"))
        return met.crossJoin(every)  # one row each


def _nearest(distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, donor) of the k least finite distances of each row; ties go to the earlier donor."""
    k = min(k, distance.shape[1])
    edge = np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
    row, donor = np.nonzero((distance <= edge) & np.isfinite(distance))
    order = np.lexsort((donor, distance[row, donor], row))
    row, donor = row[order], donor[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], donor[place < k]


def _any_null(columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def _top(search: _Search) -> DataFrame:
    order = Window.partitionBy("_row", "column").orderBy("distance", "donor", "_donor")  # k rows for each task that held donors
    return search.donors().withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= search.k)


def impute(df: DataFrame, strata: list[str], key: str, columns: list[str], targets: list[str], k: int = 3, block: int = BLOCK, row: str | None = None, within: list[str] | None = None, limit: float | None = None) -> DataFrame:
    """(strata, key, column, value): for each missing target the median of the k nearest donors' own values; ties by donor's key.

    Cells without any donor have no line, nor have rows without a stratum. Only original values donate. A row is told by its place:
    rows that share a key, or have none, are filled and donate each for itself. With row, the name of a column of unique numbers (see
    ``numbered``), the lines carry it. within and limit choose the columns of each stratum's distance, as in ``column_sets``.
    """
    top = _top(_Search(df, strata, key, columns, targets, k, False, block, row, within, limit))
    out = top.groupBy(*strata, key, "_row", "column").agg(F.median("given").alias("value"))
    return out.withColumnRenamed("_row", row) if row else out.drop("_row")


def complete(df: DataFrame, imputed: DataFrame, row: str, targets: list[str]) -> DataFrame:
    """The numbered table with imputed cells filled in, <column>_was_imputed beside them, and IMPUTED_COLUMNS and N_IMPUTED_VALUES of the row, without its numbers."""
    wide = imputed.groupBy(F.col(row).alias("_n")).pivot("column", targets).agg(F.first("value")).select("_n", *(F.col(c).alias("_" + c) for c in targets))
    out = df.join(wide, F.col(row) == F.col("_n"), "left")
    flags = {f"{c}_was_imputed": F.col(c).isNull() & F.col("_" + c).isNotNull() for c in targets}
    names = F.array_compact(F.array(*(F.when(F.col(f), F.lit(c)) for c, f in zip(targets, flags, strict=True))))
    out = out.withColumns(flags).withColumns({"IMPUTED_COLUMNS": F.array_join(F.array_sort(names), ";"), "N_IMPUTED_VALUES": F.size(names)})
    kept = [c for c in df.columns if c not in ("IMPUTED_COLUMNS", "N_IMPUTED_VALUES", row)]
    return out.withColumns({c: F.coalesce(c, "_" + c) for c in targets}).select(*kept, *flags, "IMPUTED_COLUMNS", "N_IMPUTED_VALUES")


def lovo_detail(df: DataFrame, strata: list[str], key: str, columns: list[str], targets: list[str], ks: list[int], least: int = 3, block: int = BLOCK, within: list[str] | None = None, limit: float | None = None) -> DataFrame:
    """(strata, key, column, k, truth, predicted, donors, used): every observed target predicted from the others, for all k at once; used counts the donors.

    Hiding a column takes its term from the pair's sum; a target that measures no distance has none to hide. Columns with fewer than least
    values in a stratum are skipped. Rows that share a key have lines of their own.
    """
    search = _Search(df, strata, key, columns, targets, max(ks), True, block, None, within, limit)
    counts = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().cast("long").alias("n")) for c in targets)))
    enough = df.select(*strata, counts.alias("c")).groupBy(*strata, F.col("c.column").alias("column")).agg(F.sum("c.n").alias("_n")).where(F.col("_n") >= least)
    top = _top(search).join(enough.drop("_n"), [*strata, "column"], "left_semi")
    by_k = top.withColumn("k", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("rn"))))
    names = F.transform(F.array_sort(F.collect_list(F.struct("rn", "donor"))), lambda r: F.coalesce(r["donor"].cast("string"), F.lit("")))
    return by_k.groupBy(*strata, key, "_row", "column", "k").agg(F.first("own").alias("truth"), F.median("given").alias("predicted"), F.array_join(names, ";").alias("donors"), F.count("*").alias("used")).drop("_row")


def lovo(detail: DataFrame, strata: list[str]) -> DataFrame:
    e = F.col("predicted") - F.col("truth")
    return detail.groupBy(*strata, "k").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): pairwise complete correlations, one aggregation."""
    names = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(pearson(a, b).alias(f"r{k}") for k, (a, b) in enumerate(names)))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(names)))
    return row.select(F.explode(cells).alias("c")).select("c.*")


def not_redundant(df: DataFrame, columns: list[str], limit: float = 0.9) -> list[str]:
    """Columns in order without those whose correlation with one kept before is over limit; one row comes to the driver."""
    found = column_sets(df.select("*", F.lit(0).alias("_all")), ["_all"], columns, limit=limit).collect()
    return [c for c, used in zip(columns, found[0]["used"] if found else [True] * len(columns), strict=True) if used]
