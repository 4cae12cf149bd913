"""Merkle manifest of a table by time-forward processing.

Every row is a leaf. Leaves of a source in doc_id order, 16 to a node, lead to its subroot, and the
subroots in source order to the root. A node's label is the place of its last leaf and then its level, so children
have smaller labels than their parent. The forward sweep visits nodes by label: a queue ordered by label holds the digests
sent to parents, and a node takes its children's from it. The reversed sweep visits them from the root: the queue holds
the suffixes of proofs sent to children, and a leaf takes its own.

The queue is external: nodes are cut into blocks of 16^depth in label order, which Spark's shuffle delivers to tasks, and what
passes between blocks (a digest upwards, a suffix downwards) is a row of a stored table, dealt by the label of its reader.
Within a block a heap of at most 16 messages a level does the same. So a source of any size is many tasks, a task holds one block, and each
round of blocks is 16^depth times smaller than the one below.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.ranks import running
from .common import stage

#: Children of a node, and levels of a block.
ARITY, DEPTH = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A chain of siblings from a node up to the root: those on its left, on its right, the whole rest of the proof, the next link.
Chain = tuple[bytes, bytes, bytes, "Chain | None"]


def digest_of(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def height(n: int) -> int:
    """Levels above n nodes until one remains."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def forward(digests: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of each level over a block, children's digests being sent forward to their parents in label order."""
    n, out = len(digests), [digests, *([] for _ in range(levels))]
    queue: list[tuple[int, int, int, bytes]] = []

    def send(level: int, j: int, digest: bytes) -> None:
        if level < levels:
            heapq.heappush(queue, (min((j // ARITY + 1) * ARITY ** (level + 1), n) - 1, level + 1, j, digest))

    for i, d in enumerate(digests):
        send(0, i, d)
        while queue and queue[0][0] == i:
            label, children = queue[0][:2], []
            while queue and queue[0][:2] == label:
                children.append(heapq.heappop(queue)[3])
            level = label[1]
            out[level].append(digest_of(b"".join(children)))
            send(level, len(out[level]) - 1, out[level][-1])
    return out


def backward(nodes: list[list[bytes]], chain: Chain | None) -> Iterator[tuple[int, Chain | None]]:
    """(leaf, chain) of a block from its last leaf to its first; chain is that of the block's own node."""
    n, top = len(nodes[0]), len(nodes) - 1
    queue: list[tuple[int, int, int, Chain | None]] = [(1 - n, -top, 0, chain)]
    while queue:
        _, level, j, chain = heapq.heappop(queue)
        if not level:
            yield j, chain
            continue
        level = -level - 1
        first = j * ARITY
        run = nodes[level][first : first + ARITY]
        rest = chain[2] if chain else b""
        for k in range(len(run)):
            left, right = b"".join(run[:k]), b"".join(run[k + 1 :])
            end = min((first + k + 1) * ARITY**level, n) - 1
            heapq.heappush(queue, (-end, -level, first + k, (left, right, left + right + rest, chain)))


def proof(chain: Chain | None) -> str:
    return hashlib.sha256(chain[2] if chain else b"").hexdigest()


def fold(digest: bytes, chain: Chain | None) -> bytes:
    """The root that a leaf and its siblings lead to."""
    while chain:
        left, right, _, chain = chain
        digest = digest_of(left + digest + right)
    return digest


def packed(chain: Chain | None) -> dict[str, list[str]]:
    lefts, rights = [], []
    while chain:
        lefts.append(chain[0].decode())
        rights.append(chain[1].decode())
        chain = chain[3]
    return {"lefts": lefts, "rights": rights}


def unpacked(lefts: list[str], rights: list[str]) -> Chain | None:
    chain = None
    for a, b in zip(reversed(lefts), reversed(rights), strict=True):
        left, right = a.encode(), b.encode()
        chain = (left, right, left + right + (chain[2] if chain else b""), chain)
    return chain


def _block(t: pa.Table, depth: int) -> tuple[np.ndarray, list[list[bytes]]]:
    """The order of a block's rows by place, and its nodes."""
    order = np.argsort(t["i"].to_numpy(), kind="stable")
    n = t["n"][0].as_py()
    digests = [d.encode() for d in t["digest"].take(pa.array(order)).to_pylist()]
    return order, forward(digests, height(n) if n <= ARITY**depth else depth)


def _up(nodes: DataFrame, depth: int) -> DataFrame:
    """(tree, i, n, digest) of the nodes over each block; a tree of one node stays as it is."""
    schema = to_arrow_schema(nodes.select("tree", "i", "n", "digest").schema)

    def run(t: pa.Table) -> pa.Table:
        n = t["n"][0].as_py()
        _, levels = _block(t, depth)
        return pa.table({"tree": [t["tree"][0]], "i": [t["block"][0]], "n": [-(-n // ARITY**depth)], "digest": [levels[-1][0].decode()]}, schema)

    return nodes.select("tree", "i", "n", "digest", "block").groupBy("tree", "block").applyInArrow(run, nodes.select("tree", "i", "n", "digest").schema)


MESSAGE = "tree string, i long, lefts array<string>, rights array<string>, subroot string, root string"


def _down(nodes: DataFrame, messages: DataFrame, depth: int) -> DataFrame:
    """The messages of nodes from those of the nodes over their blocks."""
    schema = to_arrow_schema(nodes.sparkSession.createDataFrame([], MESSAGE).schema)

    def run(t: pa.Table, m: pa.Table) -> pa.Table:
        if not t.num_rows:
            return schema.empty_table()
        m = m.to_pylist()[0]
        order, levels = _block(t, depth)
        tree, subroot, root = t["tree"][0].as_py(), m["subroot"], m["root"]
        places = t["i"].to_numpy()[order]
        return pa.Table.from_pylist([{"tree": tree, "i": int(places[j]), **packed(c), "subroot": subroot, "root": root} for j, c in backward(levels, unpacked(m["lefts"], m["rights"]))], schema)

    return _meet(nodes, messages).applyInArrow(run, MESSAGE)


def _meet(nodes: DataFrame, messages: DataFrame):
    return nodes.groupBy("tree", "block").cogroup(messages.withColumnRenamed("i", "block").groupBy("tree", "block"))


def _blocked(df: DataFrame, depth: int) -> DataFrame:
    return df.withColumn("block", F.floor(F.col("i") / ARITY**depth))


def _climb(leaves: DataFrame, most: int, depth: int) -> list[DataFrame]:
    """The stored nodes of each round of blocks, from the leaves to one node for each tree."""
    rounds = [leaves]
    while most > 1:
        rounds.append(_blocked(stage(_up(rounds[-1], depth), "merkle-nodes"), depth))
        most = -(-most // ARITY**depth)
    return rounds


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*(field(F.col(f) if f != "text" else text) for f in FIELDS)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, i, n, digest, doc_id, tampered): every row's digest and its place among the n of its source.

    tampered is the digest of the row with A-Z of its text in lower case, where 5 divides the crc32 of the decimal doc_id; else null.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.select(field(F.col("source")).alias("tree"), "source", "doc_id", leaf(F.col("text")).alias("digest"), F.when(hit, leaf(F.translate("text", UPPER, LOWER))).alias("tampered"))
    rows = stage(rows, "merkle-rows")  # texts are hashed once, not again for the bounds of the ranges
    dealt = rows.repartitionByRange("source", "doc_id", "digest").sortWithinPartitions("source", "doc_id", "digest").drop("source")
    dealt = stage(dealt.withColumn("pos", F.monotonically_increasing_id()), "merkle-leaves").withColumn("part", F.shiftright("pos", 33))
    # a row for each source and part: where its leaves begin there, and how many come before
    runs = dealt.groupBy("part", "tree").agg(F.min("pos").alias("first"), F.count("*").alias("m"))
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("m").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("part", "tree", (before - F.col("first")).alias("shift"), F.sum("m").over(own).alias("n"))
    return dealt.join(runs, ["part", "tree"]).select("tree", (F.col("pos") + F.col("shift")).alias("i"), "n", "digest", "doc_id", "tampered")


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Nulls are fields of their own; a null source is a source, the first. Rows without doc_id come first in their source, and rows of
    one doc_id in the order of their digests, so that repeated rows are leaves of their own. An empty table has no rows. Other columns take no part.
    """
    base = _blocked(stage(leaves(docs), "merkle-places"), depth)
    most = base.agg(F.max("n")).first()[0] or 0
    rounds = _climb(base, most, depth)
    tops = rounds[-1].select("tree", "digest") if most > 1 else base.select("tree", "digest")
    # the subroots are the leaves of one more tree
    source = F.when(F.col("tree") != "-", F.expr("substring(tree, instr(tree, ':') + 1)"))
    placed = running(tops.withColumn("source", source), ["source"]).select("tree", "digest", (F.col("upto") - 1).alias("i"))
    n = placed.count()
    subroots = _blocked(stage(placed.select(F.lit("").alias("tree"), "i", F.lit(n).cast("long").alias("n"), "digest", F.col("tree").alias("of")), "merkle-subroots"), depth)
    above = _climb(subroots, n, depth)
    none = F.array().cast("array<string>")
    last = above[-1].select("tree", "i", none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(above[:-1]):
        last = stage(_down(nodes, last, depth), "merkle-suffixes")
    sent = last.drop("tree", "subroot").join(subroots.select("i", F.col("of").alias("tree"), F.col("digest").alias("subroot")), "i")
    sent = sent.select("tree", F.lit(0).cast("long").alias("i"), "lefts", "rights", "subroot", "root")
    for nodes in reversed(rounds[1:-1]):
        sent = stage(_down(nodes, sent, depth), "merkle-suffixes")
    return _proofs(base, sent, depth)


def _proofs(base: DataFrame, messages: DataFrame, depth: int) -> DataFrame:
    """The last step of the reversed sweep: leaves take their suffixes, hash their proofs and fold them."""
    schema = base.select("doc_id").schema.add("leaf", "string").add("subroot", "string").add("root", "string").add("proof_sha256", "string").add("folded_root", "string").add("verified", "boolean")
    arrow = to_arrow_schema(schema)

    def run(t: pa.Table, m: pa.Table) -> pa.Table:
        if not t.num_rows:
            return arrow.empty_table()
        m = m.to_pylist()[0]
        order, levels = _block(t, depth)
        t = t.take(pa.array(order))
        ids, own, other = (t[c].to_pylist() for c in ("doc_id", "digest", "tampered"))
        rows = []
        for j, chain in backward(levels, unpacked(m["lefts"], m["rights"])):
            root = fold((other[j] or own[j]).encode(), chain).decode()
            rows.append((ids[j], own[j], m["subroot"], m["root"], proof(chain), root, root == m["root"]))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return _meet(base, messages).applyInArrow(run, schema)


#: Levels, siblings and folds by recursion; the places of nodes tell their runs. crc32 of the decimal doc_id is folded from its bits.
ORACLE = r"""
WITH RECURSIVE steps AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), docs AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text, coalesce(xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 5 = 0, FALSE) AS hit
  FROM documents, steps
), leaves AS (
  SELECT doc_id, source, hit, sha256(head || coalesce(octet_length(encode(text))::VARCHAR || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(lower_text))::VARCHAR || ':' || lower_text, '-')) AS other
  FROM (SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR))::VARCHAR || ':' || doc_id::VARCHAR, '-') || coalesce(octet_length(encode(source))::VARCHAR || ':' || source, '-') || coalesce(octet_length(encode(lang))::VARCHAR || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR))::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head FROM docs)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves
), low AS (
  SELECT 0 AS level, source, i, n, leaf AS d FROM placed
  UNION ALL
  SELECT level + 1, source, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY level, source, i // 16
), subroots AS (
  SELECT source, d AS subroot, level AS high, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, i, n, subroot AS d FROM subroots
  UNION ALL
  SELECT level + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(d, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 16
), top AS (
  SELECT d AS root FROM high WHERE n = 1
), siblings AS (
  SELECT source, level, i, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM low WHERE n > 1
  WINDOW w AS (PARTITION BY source, level, i // 16 ORDER BY i)
), above AS (
  SELECT level, i, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM high WHERE n > 1 WINDOW w AS (PARTITION BY level, i // 16 ORDER BY i)
), walk AS (
  SELECT 0 AS step, p.doc_id, p.leaf, p.source, p.i, s.i AS j, s.high, CASE WHEN p.hit THEN p.other ELSE p.leaf END AS d, '' AS sibs, FALSE AS over FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source
  UNION ALL
  SELECT step + 1, w.doc_id, w.leaf, w.source, w.i, w.j, w.high, CASE WHEN coalesce(a.l, b.l) IS NULL THEN w.d ELSE sha256(coalesce(a.l, b.l) || w.d || coalesce(a.r, b.r)) END, w.sibs || coalesce(a.l, b.l, '') || coalesce(a.r, b.r, ''), coalesce(a.l, b.l) IS NULL
  FROM walk w LEFT JOIN siblings a ON w.step < w.high AND a.source IS NOT DISTINCT FROM w.source AND a.level = w.step AND a.i = w.i // (16 ** w.step)::BIGINT
  LEFT JOIN above b ON w.step >= w.high AND b.level = w.step - w.high AND b.i = w.j // (16 ** greatest(w.step - w.high, 0))::BIGINT
  WHERE NOT w.over
)
SELECT w.doc_id, w.leaf, s.subroot, t.root, sha256(w.sibs) AS proof_sha256, w.d AS folded_root, w.d = t.root AS verified
FROM walk w JOIN subroots s ON s.source IS NOT DISTINCT FROM w.source, top t WHERE w.over
"""
