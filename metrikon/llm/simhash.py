"""SimHash near-dedup with pigeonring filtering.

64-bit fingerprints of word shingles; two fingerprints are linked at ``BUDGET`` or
fewer differing bits. The bits lie in ``SEGMENTS`` segments on a ring. By the
pigeonring principle a linked pair has a start from which every chain of l
consecutive segments differs in at most l * BUDGET / SEGMENTS bits; so the first
segment is equal and the second differs in one bit at most. Candidates come from
such keys only, the longer chains prune them, and the full distance decides.
Equal fingerprints are one node. Links come as a forest of each candidate group,
never as all its pairs, and components from contracting rounds on tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, parts, spans, stage, strings, unused

BUDGET, SEGMENTS = 4, 5
EDGES = [round(64 * k / SEGMENTS) for k in range(SEGMENTS + 1)]
WIDTH = [b - a for a, b in zip(EDGES, EDGES[1:], strict=False)]
SHINGLE, SEED = 4, 42
CHUNK = 1 << 20

#: Each byte value as eight counters of one byte, lowest bit first.
LANES = np.ascontiguousarray(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).view(U64).ravel()


def majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For runs of 64-bit hashes of the given sizes: bits set in over half of a run; 0 for empty runs."""
    out = np.zeros(len(sizes), U64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    runs = (sizes[full] + 254) // 255  # pieces of at most 255 rows, so that byte counters hold
    first = np.cumsum(sizes[full]) - sizes[full]
    begin = np.repeat(np.cumsum(runs) - runs, runs)
    at = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - begin)
    octets = h.view(np.uint8).reshape(-1, 8)
    fingerprint = np.zeros(len(full), U64)
    for k in range(8):
        counts = np.add.reduceat(LANES[octets[:, k]], at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(counts, np.cumsum(runs) - runs, axis=0)
        bits = np.packbits(2 * counts > sizes[full][:, None], axis=1, bitorder="little").ravel()
        fingerprint |= bits.astype(U64) << U64(8 * k)
    out[full] = fingerprint
    return out


def _hashes(text: bytes) -> list[int]:
    """XXH64 of each shingle of a lower-cased text; fewer words make one, none makes none."""
    w = text.lower().split()
    if len(w) <= SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else []
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[: -SHINGLE] + 1]).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, tie long): the fingerprint's bits as a signed long, and a hash that tells texts of one doc_id apart. Null and wordless texts have fingerprint 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    return printed(rows, "fp").select("doc_id", "fp", "tie")


def printed(docs: DataFrame, name: str) -> DataFrame:
    """The rows with their fingerprint in a column of that name."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offsets = strings(b.column(where))
            found = []
            for lo, hi in spans(offsets, CHUNK):
                part = [np.array(_hashes(flat[offsets[i] : offsets[i + 1]].tobytes()), U64) for i in range(lo, hi)]
                found.append(majority(np.concatenate(part), np.array([len(p) for p in part], np.int64)))
            fp = np.concatenate(found) if found else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _segment(fp: np.ndarray, k: int) -> np.ndarray:
    k %= SEGMENTS
    return (fp >> U64(EDGES[k])) & U64((1 << WIDTH[k]) - 1)


def _chained(x: np.ndarray, first: int) -> np.ndarray:
    """Whether each chain from segment first keeps within its share of the budget; x: xor of the pairs."""
    so_far, ok = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for n in range(1, SEGMENTS + 1):
        so_far += np.bitwise_count(_segment(x, first + n - 1))
        ok &= so_far * SEGMENTS <= n * BUDGET
    return ok


def _forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of one crowded group: breadth first, each row compared only with those not yet reached."""
    rest, out = fp.copy(), []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        root = front[0]
        while len(front) and len(rest):
            reached = np.zeros(len(rest), bool)
            for at in range(0, len(front), 64):
                left = np.flatnonzero(~reached)
                if not len(left):
                    break
                step = max(1, CHUNK // 64)
                for i in range(0, len(left), step):
                    near = np.bitwise_count(rest[left[i : i + step]][None, :] ^ front[at : at + 64][:, None]) <= BUDGET
                    reached[left[i : i + step][near.any(0)]] = True
            front, rest = rest[reached], rest[~reached]
            out += [(root, x) for x in front]
    return out


def links_of(ring: int, fp: np.ndarray, crowd: int = 64) -> np.ndarray:
    """Links (n, 2) among distinct fingerprints by chains that begin at segment ring; groups over crowd rows give forests."""
    a, b = _segment(fp, ring), _segment(fp, ring + 1)
    wide = WIDTH[(ring + 1) % SEGMENTS]
    key = (a << U64(wide)) | b
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    found: list[np.ndarray] = []
    heavy: set[tuple[int, int]] = set()
    values, begin, count = np.unique(key, return_index=True, return_counts=True)
    for flip in [0, *(1 << k for k in range(wide))]:
        other = values ^ U64(flip)
        at = np.searchsorted(values, other)
        hit = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == other) & (values <= other)
        mine, theirs = np.flatnonzero(hit), at[hit]
        big = count[mine] * count[theirs] > crowd * crowd
        heavy |= set(zip(mine[big].tolist(), theirs[big].tolist(), strict=True))
        mine, theirs = mine[~big], theirs[~big]
        size = count[mine] * count[theirs]
        for lo, hi in spans(np.concatenate([[0], np.cumsum(size)]), CHUNK):
            rep = np.repeat(np.arange(lo, hi), size[lo:hi])
            nth = np.arange(len(rep)) - np.repeat(np.cumsum(size[lo:hi]) - size[lo:hi], size[lo:hi])
            left, right = begin[mine[rep]] + nth // count[theirs[rep]], begin[theirs[rep]] + nth % count[theirs[rep]]
            keep = left < right if flip == 0 else np.ones(len(left), bool)
            pair = np.stack([fp[left[keep]], fp[right[keep]]], 1)
            x = pair[:, 0] ^ pair[:, 1]
            pair, x = (v[_chained(x, ring)] for v in (pair, x))
            found.append(pair[np.bitwise_count(x) <= BUDGET])
    for i, j in sorted(heavy):
        group = np.concatenate([fp[begin[k] : begin[k] + count[k]] for k in {i, j}])
        found.append(np.array(_forest(group), U64).reshape(-1, 2))
    return np.concatenate(found) if found else np.zeros((0, 2), U64)


def links(distinct: DataFrame, n: int) -> DataFrame:
    """(a, b): links among distinct fingerprints that join all that are near."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(U64)
            ring = np.repeat(np.arange(SEGMENTS), len(fp))
            key = np.concatenate([_segment(fp, k) for k in range(SEGMENTS)]) if len(fp) else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array((ring * (1 << 16) + key.astype(np.int64)).astype(np.int32)), pa.array(np.tile(fp, SEGMENTS).view(np.int64))], ["part", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy().view(U64)) for b in batches]
        if not got:
            return
        part, fp = (np.concatenate(x) for x in zip(*got, strict=True))
        for ring in range(SEGMENTS):
            pairs = links_of(ring, fp[part >> 16 == ring])
            pairs = np.unique(np.sort(pairs, axis=1), axis=0) if len(pairs) else pairs
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], ["a", "b"])

    keyed = distinct.select("fp").mapInArrow(deal, "part int, fp long")
    return keyed.repartition(n, "part").mapInArrow(run, "a long, b long").distinct()


#: A key with more than one HOT-th of all rows is split off, so fewer than HOT keys are.
HOT, FEW = 500, 200


def hot_keys(counts: DataFrame, key: str) -> tuple[int, DataFrame | None]:
    """How many rows counts (key, n) stands for, and the keys with too many of them, none if there are none."""
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = max((total or 0) / HOT, FEW)
    return total or 0, counts.where(F.col("n") > limit).select(key) if (most or 0) > limit else None


def split_join(rows: DataFrame, dim: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with dim, which is unique in key; hot: the keys that hot_keys names.

    Keys with more than 1 / HOT of the rows, fewer than HOT by that, meet their row of dim where their rows lie; the
    others are shuffled. So no task gets a whole hot key.
    """
    if hot is None:
        return rows.join(dim, key, how)
    few = F.broadcast(dim.join(F.broadcast(hot), key, "left_semi"))
    own, rest = (rows.join(F.broadcast(hot), key, kind) for kind in ("left_semi", "left_anti"))
    return own.join(few, key, how).unionByName(rest.join(dim, key, how))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of the edges: equal roots, one component.

    Each round every node joins the neighbour (or itself) of least keyed hash and edges
    are renamed; the keys change with the round, so paths shrink by a constant factor.
    Rounds end when no edge is left. Only counts come to the driver; the hub of a large
    component is renamed where its edges lie.
    """
    edges, steps = stage(edges.where("a <> b"), label), []
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"), F.count("*").alias("n")).select(F.col("a").alias("node"), F.least("m", rank("a")).getField("v").alias("up"), "n")
        least = stage(least.select("node", "up", "n"), label)
        total, hot = hot_keys(least, "node")
        if not total:
            break
        steps.append(least)
        for c in "ab":
            up = least.select(F.col("node").alias(c), F.col("up").alias("to_" + c))
            edges = split_join(edges, up, c, hot and hot.withColumnRenamed("node", c))
        edges = stage(edges.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a <> b").distinct(), label)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0].select("node", F.col("up").alias("root"))
    for step in steps[1:]:
        _, hot = hot_keys(out.groupBy("root").agg(F.count("*").alias("n")), "root")
        out = split_join(out, step.select(F.col("node").alias("root"), "up"), "root", hot, "left").select("node", F.coalesce("up", "root").alias("root"))
        out = out if hot is None else stage(out, label)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable, itself included.

    Null and wordless texts have fingerprint 0 and are linked like any other. Repeated rows
    stay rows. Rows without doc_id link others and have the component's smallest doc_id, null if no
    row of it has any; other columns are ignored. No rows, no components.
    """
    return _grouped(docs).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame) -> DataFrame:
    """near_duplicates with the root of each component, which tells components apart whose least doc_id is the same."""
    found = stage(fingerprints(docs), "fingerprints")
    distinct = stage(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    n = parts(distinct.count(), 100_000, 12)
    roots = components(links(distinct, n))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = stage(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
    named = split_join(named.select("fp", "root"), least.drop("n"), "root", hot_keys(least, "root")[1])
    names = stage(named.select("fp", "root", "component_id"), "names")
    return split_join(found, names, "fp", hot_keys(distinct, "fp")[1]).select("doc_id", "fp", "tie", "root", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the row of least doc_id (of several with it the one whose text has the least hash), one of those that repeat it. Rows without doc_id all stay.

    Texts are fingerprinted once; the rows kept are found again by doc_id and a hash of the text.
    """
    id_, tie = unused(docs.columns, "_id"), unused(docs.columns, "_tie")
    least = _grouped(docs.where("doc_id is not null")).groupBy("root").agg(F.min(F.struct("doc_id", "tie")).alias("least"))
    keep = least.select(F.col("least.doc_id").alias(id_), F.col("least.tie").alias(tie)).distinct()
    own = docs.where("doc_id is not null").withColumns({id_: F.col("doc_id").cast("long"), tie: F.xxhash64("text")})
    own = own.join(keep.hint("merge"), [id_, tie], "left_semi").dropDuplicates([id_, tie]).select(*docs.columns)
    return own.unionAll(docs.where("doc_id is null"))
