"""Nearest neighbours by a navigable small-world graph for each shard.

Vectors are dealt to shards by a hash of their id; shards grow with the table up to a
bound of memory. Each shard builds a layered graph in numpy, nodes inserted in growing
batches, and stores it as flat neighbour arrays (layer after layer, a fixed number of
slots for each node, -1 for none). Queries are packed into blocks; a shard's graph is
sent to one task once and all blocks pass by it, and shard results are merged. Equal vectors
are one node of a shard that keeps its smallest distinct ids, one more than an answer
holds. Repeated rows count once, as rows of the index and as queries; an id with
several vectors is as near as its nearest one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SLOTS, WIDE, BLOCK_QUERIES = 16, 64, 2048
#: A shard holds so many rows at least and at most; between, there are two shards for each core.
LEAST_ROWS, MOST_ROWS = 4096, 1 << 14


def width(nodes: int) -> int:
    """Candidates that a search keeps, in building too: WIDE up to 4,096 nodes, from there with the root of their number, as recall falls otherwise."""
    return max(WIDE, math.ceil(WIDE * math.sqrt(nodes / LEAST_ROWS)))


@dataclass
class Graph:
    """vectors: unit rows; layers: (nodes of the layer, neighbours (n, slots) as positions in vectors); entry: a node of the top layer."""

    vectors: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]
    entry: int

    def search(self, queries: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest nodes of each query, nearest first, with their cosines; -1 beyond those found."""
        at = np.full(len(queries), self.entry)
        best = np.einsum("ij,ij->i", queries, self.vectors[at])
        for _, links in reversed(self.layers[1:]):
            moved = np.arange(len(queries))
            while len(moved):
                near = links[at[moved]]
                cos = np.where(near >= 0, np.einsum("ij,ikj->ik", queries[moved], self.vectors[near]), -2)
                k = cos.argmax(1)
                top = cos[np.arange(len(k)), k]
                better = top > best[moved]
                moved = moved[better]
                at[moved], best[moved] = near[better, k[better]], top[better]
        return beam(self.vectors, self.layers[0][1], queries, at[:, None], wide)


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, begin: np.ndarray, wide: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of many queries at once; each turn opens the best unopened nodes of every query."""
    q, n = len(queries), len(vectors)
    row = np.arange(q)[:, None]
    seen = np.zeros((q, n), bool)
    ids = np.full((q, wide), -1)
    cos = np.full((q, wide), -3, np.float32)
    opened = np.ones((q, wide), bool)
    ids[:, : begin.shape[1]] = begin
    cos[:, : begin.shape[1]] = np.einsum("ij,ikj->ik", queries, vectors[begin])
    opened[:, : begin.shape[1]] = False
    seen[row, begin] = True
    active = np.arange(q)
    while len(active):
        a = active[:, None]
        rank = np.where(opened[active], -9, cos[active])
        pick = np.argpartition(-rank, min(step, wide - 1), axis=1)[:, :step]
        fresh = np.take_along_axis(rank, pick, 1) > -3
        opened[a, pick] = True
        near = np.where(fresh[:, :, None], links[ids[a, pick]], -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[(near >= 0) & seen[a, near]] = -1
        seen[np.broadcast_to(a, near.shape)[near >= 0], near[near >= 0]] = True
        keep = np.argsort(near < 0, axis=1, kind="stable")[:, : max(1, int((near >= 0).sum(1).max()))]
        near = np.take_along_axis(near, keep, 1)
        found = np.where(near >= 0, np.einsum("ij,ikj->ik", queries[active], vectors[near]), -3).astype(np.float32)
        all_cos, all_ids = np.concatenate([cos[active], found], 1), np.concatenate([ids[active], near], 1)
        all_opened = np.concatenate([opened[active], near < 0], 1)
        top = np.argpartition(-all_cos, wide - 1, axis=1)[:, :wide]
        cos[active], ids[active], opened[active] = (np.take_along_axis(x, top, 1) for x in (all_cos, all_ids, all_opened))
        active = active[(~opened[active]).any(1)]
    order = np.argsort(-cos, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(cos, order, 1)


def _diverse(vectors: np.ndarray, node: np.ndarray, near: np.ndarray, cos: np.ndarray, slots: int) -> np.ndarray:
    """Of each node's candidates, nearest first, those nearer to it than to one kept before; then the nearest left over fill up."""
    n, width = near.shape
    inner = np.einsum("aij,akj->aik", vectors[near], vectors[near])
    keep = np.zeros((n, width), bool)
    valid = (near >= 0) & (near != node[:, None])
    count = np.zeros(n, int)
    for j in range(width):
        closer = (np.where(keep, inner[:, j, :], -2) > cos[:, j, None]).any(1)
        keep[:, j] = valid[:, j] & ~closer & (count < slots)
        count += keep[:, j]
    order = np.argsort(np.where(keep, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :slots]
    out = np.take_along_axis(near, order, 1)
    return np.where(np.take_along_axis(valid, order, 1), out, -1)


def build(vectors: np.ndarray, slots: int = SLOTS, wide: int | None = None, seed: int = 3) -> Graph:
    """vectors: unit rows (float32), at least one."""
    n = len(vectors)
    wide = width(n) if wide is None else wide
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(1 - rng.random(n)) / math.log(slots)).astype(int), 5)
    order = np.argsort(-level, kind="stable")  # the highest first, so that layers nest as prefixes
    layers = []
    for height in range(level.max() + 1):
        members = order[: int((level >= height).sum())]
        layers.append((members, _layer(vectors, members, slots * (2 if height == 0 else 1), wide)))
    return Graph(vectors, layers, int(order[0]))


def _layer(vectors: np.ndarray, members: np.ndarray, slots: int, wide: int) -> np.ndarray:
    links = np.full((len(vectors), slots), -1)
    wide = max(wide, slots)
    done = min(len(members), 2 * slots)
    first = members[:done]
    cos = vectors[first] @ vectors[first].T
    near = np.argsort(-cos, axis=1, kind="stable")
    links[first, : min(slots, done)] = _diverse(vectors, first, first[near], np.take_along_axis(cos, near, 1), slots)[:, :slots]
    while done < len(members):
        new = members[done : done + min(done, 512)]
        begin = np.broadcast_to(members[:: max(1, done // 8)][:8][None], (len(new), len(members[:: max(1, done // 8)][:8])))
        begin = np.where(np.isin(begin, members[:done]), begin, members[0])
        begin = np.unique(begin, axis=1) if begin.shape[1] > 1 else begin
        near, cos = beam(vectors, links, vectors[new], begin, wide)
        peers = vectors[new] @ vectors[new].T  # of one batch: nearest of the others
        np.fill_diagonal(peers, -3)
        some = min(8, len(new))
        k = np.argpartition(-peers, some - 1, axis=1)[:, :some]
        near, cos = np.concatenate([near, new[k]], 1), np.concatenate([cos, np.take_along_axis(peers, k, 1)], 1)
        o = np.argsort(-cos, axis=1, kind="stable")[:, :wide]
        near, cos = np.take_along_axis(near, o, 1), np.take_along_axis(cos, o, 1)
        links[new] = _diverse(vectors, new, near, cos, slots)
        # back links: every node that was linked chooses anew among its own and the new ones
        source, target = np.repeat(new, slots), links[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        o = np.argsort(target, kind="stable")
        source, target = source[o], target[o]
        node, at, size = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(at, size)
        gain = np.einsum("ij,ij->i", vectors[source], vectors[target])
        o = np.lexsort((-gain, target))
        extra = np.full((len(node), min(int(size.max()), 2 * slots)), -1)
        ok = place < extra.shape[1]
        extra[np.repeat(np.arange(len(node)), size)[ok], place[ok]] = source[o][ok]
        near = np.concatenate([links[node], extra], 1)
        cos = np.where(near >= 0, np.einsum("ij,ikj->ik", vectors[node], vectors[near]), -3)
        o = np.argsort(-cos, axis=1, kind="stable")
        near, cos = np.take_along_axis(near, o, 1), np.take_along_axis(cos, o, 1)
        for lo in range(0, len(node), 1024):
            links[node[lo : lo + 1024]] = _diverse(vectors, node[lo : lo + 1024], near[lo : lo + 1024], cos[lo : lo + 1024], slots)
        done += len(new)
    return links


def even(flat: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two to a largest component between 1/2 and 1: no product over- or underflows, and cosines keep every bit."""
    _, power = np.frexp(np.abs(flat).max(1))
    return np.ldexp(flat, -power[:, None])


INDEX = "shard int, dims int, keep int, ids array<long>, owner array<int>, vectors binary, members array<binary>, links array<binary>, entry int"


def _flat(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dims))


def _node(t: pa.Table, keep: int, slots: int, wide: int | None) -> dict:
    """The index row of one shard."""
    dims = t["dims"][0].as_py()
    t = t.sort_by("vec_id")
    ids, flat = t["vec_id"].to_numpy(), _flat(t["embedding"], dims)
    _, first, node = np.unique(flat.view(f"V{8 * dims}").ravel(), return_index=True, return_inverse=True)
    once = np.concatenate([[True], (np.diff(ids[o := np.lexsort((ids, node))]) != 0) | (np.diff(node[o]) != 0)])
    ids, node = ids[o][once], node[o][once]  # by node, distinct ids in order
    place = np.arange(len(node)) - np.repeat(np.cumsum(c := np.bincount(node)) - c, c)
    held = place < keep
    own = even(flat[first])
    g = build((own / np.linalg.norm(own, axis=1, keepdims=True)).astype(np.float32), slots, wide)
    row = {"shard": t["shard"][0].as_py(), "dims": dims, "keep": keep, "ids": ids[held].tolist(), "owner": node[held].tolist(), "vectors": own.tobytes(), "entry": g.entry}
    return row | {"members": [m.astype("<i4").tobytes() for m, _ in g.layers], "links": [x[m].astype("<i4").tobytes() for m, x in g.layers]}


def index(vectors: DataFrame, shard_rows: int | None = None, k: int = 5, slots: int = SLOTS, wide: int | None = None) -> DataFrame:
    """One row for each shard: ids by node (owner), vectors of the nodes in double precision (scaled by powers of two), flat neighbour arrays.

    vectors: (vec_id, embedding). Null, zero and non-finite vectors and null ids take no part; k is the most that a
    search may ask for, so a node of equal vectors holds k + 1 ids, the asking one among them. Repeated rows lie in one shard
    and count once. Vectors of another length than others of their shard are a graph of their own. No rows, no shards.
    """
    rows, keep = usable(vectors), k + 1
    n = rows.count()
    if shard_rows is None:
        shard_rows = min(max(n // (2 * vectors.sparkSession.sparkContext.defaultParallelism), LEAST_ROWS), MOST_ROWS)
    shards = max(1, math.ceil(n / shard_rows))
    arrow = pa.schema([("shard", pa.int32()), ("dims", pa.int32()), ("keep", pa.int32()), ("ids", pa.list_(pa.int64())), ("owner", pa.list_(pa.int32())), ("vectors", pa.binary()), ("members", pa.list_(pa.binary())), ("links", pa.list_(pa.binary())), ("entry", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of one shard and length, which follow each other

        def whole() -> pa.RecordBatch:
            row = _node(pa.Table.from_batches(held), keep, slots, wide)
            held.clear()
            return pa.RecordBatch.from_pylist([row], arrow)

        for b in batches:
            shard, dims = b.column("shard").to_numpy(), b.column("dims").to_numpy()
            turns = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(dims) != 0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(turns, turns[1:], strict=False):
                if held and lo < hi and (held[0].column("shard")[0].as_py(), held[0].column("dims")[0].as_py()) != (int(shard[lo]), int(dims[lo])):
                    yield whole()
                if lo < hi:
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield whole()

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("dims", F.size("embedding"))
    return dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "dims").mapInArrow(run, INDEX)


def usable(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


class _Shard:
    """One shard's index row, ready to be asked."""

    def __init__(self, r: dict):
        own = np.frombuffer(r["vectors"], "<f8").reshape(-1, r["dims"])
        layers = []
        for m, x in zip(r["members"], r["links"], strict=True):
            m = np.frombuffer(m, "<i4")
            links = np.full((len(own), len(x) // 4 // len(m)), -1)
            links[m] = np.frombuffer(x, "<i4").reshape(len(m), -1)
            layers.append((m, links))
        self.key, self.held, self.own, self.size = (r["shard"], r["dims"]), r["keep"] - 1, own, np.linalg.norm(own, axis=1)
        self.graph = Graph((own / self.size[:, None]).astype(np.float32), layers, r["entry"])
        owner = np.array(r["owner"])
        self.first = np.searchsorted(np.sort(owner), np.arange(len(own) + 1))
        self.ids = np.array(r["ids"])[np.argsort(owner, kind="stable")]

    def nearest(self, names: np.ndarray, flat: np.ndarray, k: int, wide: int | None) -> Iterator[tuple[int, int, float]]:
        if k > self.held:
            raise ValueError(f"{k} nearest asked of an index for {self.held}")
        _, node = np.unique(flat.view(f"V{8 * flat.shape[1]}").ravel(), return_inverse=True)
        _, once = np.unique(np.stack([names, node]), axis=1, return_index=True)
        names, flat = names[once], even(flat[once])  # distinct queries, by id
        for lo in range(0, len(names), 256):
            x = flat[lo : lo + 256]
            norm = np.linalg.norm(x, axis=1)
            near, _ = self.graph.search((x / norm[:, None]).astype(np.float32), max(wide or width(len(self.own)), k + 1))
            for i, found in enumerate(near):
                found = found[found >= 0]
                exact = (self.own[found] * x[i]).sum(1) / (self.size[found] * norm[i])  # row by row: equal vectors, equal sums
                rows = [(-s, v) for s, f in zip(exact.tolist(), found.tolist(), strict=True) for v in self.ids[self.first[f] : self.first[f + 1]].tolist() if v != names[lo + i]]
                best: dict[int, float] = {}
                for s, v in sorted(rows):
                    if len(best) < k:
                        best.setdefault(v, -s)
                yield from ((int(names[lo + i]), v, s) for v, s in best.items())


def _packed(t: pa.Table) -> pa.Table:
    """A block of queries as one row."""
    dims = t["dims"][0].as_py()
    row = {"dims": dims, "turn": t["turn"][0].as_py(), "names": t["vec_id"].to_numpy().astype("<i8").tobytes(), "asked": _flat(t["embedding"], dims).tobytes()}
    return pa.Table.from_pylist([row], pa.schema([("dims", pa.int32()), ("turn", pa.int32()), ("names", pa.binary()), ("asked", pa.binary())]))


def search(graphs: DataFrame, queries: DataFrame, k: int = 5, wide: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found, by cosine in double precision on the original vectors.

    k is at most that of the index; graphs is best a stored one. queries: (vec_id, embedding), of which usable rows count, repeated ones
    once; an id with several vectors has the best answers of all. Fewer candidates than k give fewer rows; a query without
    candidates of its length has none. Each shard's graph goes to one task once, where the blocks of queries pass by.
    """
    queries = usable(queries)
    n_blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    shards = (graphs.agg(F.max("shard")).first()[0] or 0) + 1
    asked = queries.withColumn("dims", F.size("embedding")).withColumn("turn", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
    blocks = asked.groupBy("dims", "turn").applyInArrow(_packed, "dims int, turn int, names binary, asked binary")
    to_all = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))  # a stated set of queries, in blocks, against every shard
    line = graphs.withColumn("turn", F.lit(-1)).unionByName(to_all, allowMissingColumns=True)
    line = line.repartitionById(shards, "shard").sortWithinPartitions("shard", "dims", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if r["turn"] < 0:
                    shard = _Shard(r)
                elif shard is not None and shard.key == (r["shard"], r["dims"]):
                    names = np.frombuffer(r["names"], "<i8")
                    out = list(shard.nearest(names, np.frombuffer(r["asked"], "<f8").reshape(len(names), -1), k, wide))
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    found = line.mapInArrow(run, "query_id long, vec_id long, score double")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # ids with several vectors
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows for each shard
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    return search(stage(index(vectors), "graphs"), vectors.where("vec_id % 50 = 0"))
