"""Substring dedup by difference-cover anchors.

A window of ``WINDOW`` words is repeated if its words also start earlier (smaller
doc_id, or the same document further left). Only windows of ``ANCHOR`` words at
positions whose remainder modulo ``PERIOD`` lies in ``COVER`` are hashed first.
COVER is a perfect difference set, so two equal windows share an anchor at the
same shift of at most PERIOD - 1, and ANCHOR + PERIOD - 1 <= WINDOW. Anchors seen
once end the matter; around the others the windows themselves are compared by
128-bit hashes, the extension step. A window's hash is a polynomial over keyed
128-bit hashes of its words.

Documents are dealt once into blocks by a hash of doc_id and text and stored bucketed,
so no later step shuffles texts. Each block first settles what it can alone and sends
one entry for each distinct hash, so that a passage shared by a third of all
documents costs an entry for each block, not for each document. Rows have an order of
their own: by doc_id (null last), then by a hash of the text, then by their place.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, fresh_path, parts, release, rolling, stage, text_bytes

WINDOW, ANCHOR, PERIOD = 20, 8, 13
COVER = (0, 1, 3, 9)
SENT = "bucket int, block int, hashes binary"
#: A window: its two hashes, its row's place in the order (doc_id, hash of the text, row of the block) and its first word.
ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("row", "<i4"), ("start", "<i4")])
#: Windows to remove: row of the block, first start, how many.
FLAG = np.dtype([("row", "<i4"), ("start", "<i4"), ("n", "<i4")])
#: What stands for a missing doc_id in the order.
LAST = np.iinfo(np.int64).max


class _Words(dict):
    """Numbers of distinct words, with two hash lanes of each."""

    def __init__(self) -> None:
        super().__init__()
        self.lanes: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.lanes)
        self.lanes.append(xxhash.xxh3_128_digest(word, 11))
        return n


def _block(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's rows in their order: first word of each (and the end), row of each word, two hash lanes of each word."""
    t = t.sort_by([("order", "ascending"), ("tie", "ascending")])
    known, numbers, sizes = _Words(), [], []
    for text in t["text"]:
        w = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
        sizes.append(len(w))
        numbers.append(np.fromiter(map(known.__getitem__, w), np.int32, len(w)))
    first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    lanes = np.frombuffer(b"".join(known.lanes), "<u8").reshape(-1, 2).T
    words = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
    return t, first, np.repeat(np.arange(t.num_rows), sizes), np.ascontiguousarray(lanes[:, words])


def _anchors(first: np.ndarray, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the block's anchors and their hashes."""
    at = np.arange(len(doc))
    here = at - first[doc]
    ok = np.isin(here % PERIOD, COVER) & (at + ANCHOR <= first[doc + 1])
    at = at[ok]
    return at, rolling(h[0], ANCHOR, 21)[at] if len(at) else np.zeros(0, U64)


def _cut_by(where: np.ndarray, values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The values of each bucket, by one sort."""
    order = np.argsort(where, kind="stable")
    names, begin = np.unique(where[order], return_index=True)
    return list(zip(names.tolist(), np.split(values[order], begin[1:]), strict=True)) if len(values) else []


def among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which x are in the sorted values."""
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def _send_anchors(n_buckets: int):
    def run(t: pa.Table) -> pa.Table:
        block = t["block"][0].as_py()
        t, first, doc, h = _block(t)
        values, counts = np.unique(_anchors(first, doc, h)[1], return_counts=True)
        values = np.sort(np.concatenate([values, values[counts > 1]]))  # twice: repeated within the block
        rows = [(b, block, x.tobytes()) for b, x in _cut_by((values % U64(n_buckets)).astype(np.int32), values)]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int32()), "hashes": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _repeated(t: pa.Table) -> pa.Table:
    """Of one hash bucket: to each block its own hashes that occur more than once anywhere."""
    own = [np.frombuffer(x.as_py(), U64) for x in t["hashes"]]
    values, counts = np.unique(np.concatenate(own), return_counts=True)
    values = values[counts > 1]
    back = [np.unique(x[among(x, values)]) for x in own]
    return pa.table({"bucket": t["bucket"], "block": t["block"], "hashes": pa.array([x.tobytes() for x in back], pa.binary())}).filter(pa.array([len(x) > 0 for x in back], pa.bool_()))


def _pack(entry: np.ndarray) -> bytes:
    """Column after column, which shuffles compress better than rows."""
    return b"".join(np.ascontiguousarray(entry[f]).tobytes() for f in ENTRY.names)


def _unpack(data: bytes) -> np.ndarray:
    out, at = np.zeros(len(data) // ENTRY.itemsize, ENTRY), 0
    for f in ENTRY.names:
        out[f] = np.frombuffer(data, ENTRY[f], len(out), at)
        at += len(out) * ENTRY[f].itemsize
    return out


def _flags(row: np.ndarray, start: np.ndarray) -> bytes:
    """Window starts by ascending row and position as runs."""
    if not len(row):
        return b""
    new = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (np.diff(row) != 0)]))
    out = np.zeros(len(new), FLAG)
    out["row"], out["start"], out["n"] = row[new], start[new], np.diff(new, append=len(row))
    return out.tobytes()


def _send_windows(n_buckets: int):
    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if t.num_rows and known.num_rows:
            block = t["block"][0].as_py()
            t, first, doc, h = _block(t)
            at, hashes = _anchors(first, doc, h)
            hot = np.concatenate([np.frombuffer(x.as_py(), U64) for x in known["hashes"]])
            at = at[among(hashes, np.sort(hot))]
            near = np.zeros(len(doc) + 1, np.int32)  # windows that hold a repeated anchor
            np.add.at(near, np.maximum(at - (WINDOW - ANCHOR), first[doc[at]]), 1)
            np.add.at(near, at + 1, -1)
            at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            at = at[at + WINDOW <= first[doc[at] + 1]]
            if len(at):
                a, b = (rolling(h[k], WINDOW, 31 + k)[at] for k in (0, 1))
                order = np.lexsort((at, b, a))
                new = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])
                rest = np.sort(at[order[~new]])
                if len(rest):
                    out.append((n_buckets + block, block, _flags(doc[rest], rest - first[doc[rest]])))
                one = np.sort(order[new])
                entry, row = np.zeros(len(one), ENTRY), doc[at[one]]
                entry["a"], entry["b"], entry["row"], entry["start"] = a[one], b[one], row, at[one] - first[row]
                entry["doc"], entry["tie"] = t["order"].to_numpy()[row], t["tie"].to_numpy()[row]
                out += [(x, block, _pack(e)) for x, e in _cut_by((entry["a"] % U64(n_buckets)).astype(np.int32), entry)]
        return pa.table({"bucket": pa.array([r[0] for r in out], pa.int32()), "block": pa.array([r[1] for r in out], pa.int32()), "hashes": pa.array([r[2] for r in out], pa.binary())})

    return run


def _later(n_buckets: int):
    def run(t: pa.Table) -> pa.Table:
        """Of one hash bucket: to each block those of its windows that start earlier elsewhere. Flags pass through."""
        if t["bucket"][0].as_py() >= n_buckets:
            return t
        own = [_unpack(x.as_py()) for x in t["hashes"]]
        return _flag_later(np.concatenate(own), np.repeat(t["block"].to_numpy(), [len(x) for x in own]))

    return run


def _flag_later(e: np.ndarray, block: np.ndarray) -> pa.Table:
    order = np.lexsort((e["start"], e["row"], block, e["tie"], e["doc"], e["b"], e["a"]))
    e, block = e[order], block[order]
    late = np.concatenate([[False], (np.diff(e["a"]) == 0) & (np.diff(e["b"]) == 0)])
    e, block = e[late], block[late]
    order = np.lexsort((e["start"], e["row"]))
    flags = [(b, _flags(x["row"], x["start"])) for b, x in _cut_by(block[order], e[order])]
    return pa.table({"bucket": pa.array([-1] * len(flags), pa.int32()), "block": pa.array([b for b, _ in flags], pa.int32()), "hashes": pa.array([f for _, f in flags], pa.binary())})


def _cut(t: pa.Table, known: pa.Table) -> pa.Table:
    """Of one block: removed word ranges and what is kept."""
    t = t.sort_by([("order", "ascending"), ("tie", "ascending")])
    runs = np.concatenate([np.frombuffer(x.as_py(), FLAG) for x in known["hashes"]] or [np.zeros(0, FLAG)])
    runs = runs[np.lexsort((runs["start"], runs["row"]))]
    ends = np.searchsorted(runs["row"], np.arange(t.num_rows + 1)).tolist()
    n, gone, removed, kept = [], [], [], []
    for k, text in enumerate(t["text"]):
        w = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
        n.append(len(w))
        mine = runs[ends[k] : ends[k + 1]]
        if len(mine):
            edge = np.zeros(len(w) + 1, np.int32)
            np.add.at(edge, mine["start"], 1)
            np.add.at(edge, mine["start"] + mine["n"] + WINDOW - 1, -1)
            keep = np.cumsum(edge[:-1]) == 0
            w = list(itertools.compress(w, keep))
            turns = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
            removed.append([{"start": int(i), "end": int(j)} for i, j in turns.reshape(-1, 2)])
        else:
            removed.append([])
        gone.append(n[-1] - len(w))
        kept.append(b" ".join(w))
    return pa.table({
        "doc_id": t["doc_id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
        "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
    })


def dedup_substrings(docs: DataFrame, block_bytes: int = 8 << 20, bucket_bytes: int = 24 << 20, tasks: int = 20_000) -> DataFrame:
    """(doc_id, n_words, n_removed, removed ranges of words, kept text) of each row.

    A null text has no words; documents under WINDOW words keep all. Rows of one doc_id are documents of their own
    in the order of a hash of their texts: of repeated rows one keeps its words and the others lose what it holds. Rows
    without doc_id come after all others. The SQL of the query takes doc_id to be unique. Other columns are ignored.
    block_bytes bounds what a worker holds of texts (or one text, if longer, or the repetitions of one row);
    bucket_bytes is the text behind one bucket of hashes. A task takes several blocks one after another once there are
    more than tasks of them.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    total = text_bytes(docs)
    n_blocks, n_hash = parts(total, block_bytes, 6), parts(total, bucket_bytes, 12)
    n_files = min(n_blocks, tasks)
    name = f"substring_blocks_{uuid.uuid4().hex}"
    docs = docs.withColumns({"order": F.coalesce("doc_id", F.lit(LAST)), "tie": F.xxhash64("text")})
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("order", "tie"), F.lit(n_blocks)).cast("int"))
    dealt.repartition(n_files, "block").write.bucketBy(n_files, "block").option("path", fresh_path(spark, name)).saveAsTable(name)
    release(spark)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: its files stay in the shared folder
    anchors = blocks.groupBy("block").applyInArrow(_send_anchors(n_hash), SENT)
    known = anchors.groupBy("bucket").applyInArrow(_repeated, SENT)
    sent = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_send_windows(n_hash), SENT)
    flags = stage(sent.groupBy("bucket").applyInArrow(_later(n_hash), SENT), "flags")
    release(spark)
    schema = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"
    return blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_cut, schema)


def digest(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute(rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple[int | None, int, int, str]]:
    """The same by dictionary, for tests: rows are (doc_id, text)."""
    tie = lambda t: 42 if t is None else (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64 - 2**63
    split = [(i, (t or "").encode().split()) for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, tie(r[1])))]
    seen, out = set(), []
    for i, w in split:
        keep = [True] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                keep[s : s + window] = [False] * window
            seen.add(key)
        left = b" ".join(itertools.compress(w, keep))
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(left).hexdigest()))
    return out
