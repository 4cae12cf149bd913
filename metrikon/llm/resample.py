"""Importance resampling of documents towards a target's distribution of hashed n-grams.

Features are runs of one and two words, hashed to buckets by crc32. The counts of all documents and of all
target texts give each bucket a gain, the log ratio of its smoothed shares; a document's weight is the mean gain
over its features, and adding Gumbel noise keyed by doc_id and taking the highest scores draws without replacement.

Texts are taken by batches: a batch is joined with separators, one regular expression finds the words of all, the place of
each word among the documents' offsets tells its document, and runs that would cross documents are masked before they are counted.
crc32 is linear, so that of two words comes from theirs by a table of shifts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.ranks import running
from .common import spans, stage, strings

BUCKETS, SEED, SHARE, LEAST = 10_000, 7, 25, 20
#: A byte that is in no word; splitting at each leaves the words and, between neighbouring gaps, nothing.
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
#: The same before letters are lowered.
OUTSIDE = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of texts that are joined at once; a longer text stands alone.
BATCH = 4 << 20
#: Up to this length a second word's crc32 is joined by the table.
SHORT = 64


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


TABLE = _table()


def _shifts() -> np.ndarray:
    """[length, byte's place, byte]: what a byte of a crc becomes when so many bytes follow."""
    c = np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]
    out = [c]
    for _ in range(SHORT):
        c = TABLE[c & 255] ^ (c >> 8)
        out.append(c)
    return np.stack(out)


SHIFTS = _shifts().reshape(-1)
SPACE = np.uint32(zlib.crc32(b" "))


def _joined(first: np.ndarray, second: np.ndarray | np.uint32, length: np.ndarray | int) -> np.ndarray:
    """crc32 of two parts from theirs and the length of the second."""
    at = (np.asarray(length, np.int64) * 4) << 8
    out = np.broadcast_to(second, first.shape).copy()
    for k in range(4):
        out ^= SHIFTS[at + (k << 8) + ((first >> (8 * k)) & 255)]
    return out


def features(texts: list[bytes], again: list[bool] | None = None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every run of one or two words, single words first; where again is true the first word counts in its pair alone."""
    fields = GAP.split(b"\0".join(texts).lower())  # of bytes only A-Z are lowered
    lengths = np.fromiter(map(len, fields), np.int64, len(fields))
    starts = np.cumsum(lengths + 1) - lengths - 1  # fields lie one byte apart
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    there = lengths > 0
    starts, lengths, words = starts[there], lengths[there], list(filter(None, fields))
    doc = np.searchsorted(offsets, starts, "right") - 1
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    inside = np.flatnonzero(doc[1:] == doc[:-1])  # pairs within one text
    after = lengths[inside + 1]
    short = after <= SHORT
    pair = np.empty(len(inside), np.uint32)
    pair[short] = _joined(_joined(crc[inside[short]], SPACE, 1), crc[inside[short] + 1], after[short])
    for i in np.flatnonzero(~short):
        j = inside[i]
        pair[i] = zlib.crc32(words[j + 1], zlib.crc32(b" ", int(crc[j])))
    own = np.ones(len(words), bool)
    if again:
        own[np.searchsorted(doc, np.flatnonzero(again))] = False
    return np.concatenate([doc[own], doc[inside]]), (np.concatenate([crc[own], pair]) % buckets).astype(np.int64)


def pieces(text: bytes, size: int = BATCH) -> Iterator[tuple[bytes, bool]]:
    """A text in pieces of about size bytes that end with a word; each begins with the last word of the one before, and is then marked so."""
    begin, end, lead = 0, size, False
    while end < len(text) and (gap := OUTSIDE.search(text, end)):
        end = gap.start()
        yield text[begin:end], lead
        tail = end  # the last word may lie before further gaps
        while tail > begin and OUTSIDE.match(text, tail - 1):
            tail -= 1
        first = tail
        while first > begin and not OUTSIDE.match(text, first - 1):
            first -= 1
        lead = first < tail
        begin = first if lead else end
        end += size
    yield text[begin:], lead


def _batches(column: pa.Array) -> Iterator[tuple[np.ndarray, list[bytes], list[bool]]]:
    """(rows, texts, again) of about a batch's bytes; a longer text comes in pieces of its own."""
    flat, offsets = strings(column)
    for lo, hi in spans(offsets, BATCH):
        if hi - lo == 1:
            for text, again in pieces(flat[offsets[lo] : offsets[hi]].tobytes()):
                yield np.array([lo]), [text], [again]
        else:
            yield np.arange(lo, hi), [flat[a:b].tobytes() for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)], []


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the features of all texts; a task sends one row for each of its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, texts, again in _batches(b.column(0)):
                total += np.bincount(features(texts, again, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return df.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, by bucket."""
    s, t, n = float(source.sum()), float(target.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def _vector(counts: DataFrame, buckets: int) -> np.ndarray:
    """One number for each bucket, however many texts there are."""
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():
        out[r.bucket] = r.n
    return out


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times) a Gumbel variate from the hash of seed and doc_id; a row without doc_id hashes the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight): the mean gain over the features, floored; 0 without any."""
    buckets = len(gain)
    schema = docs.select("doc_id").schema.add("n_features", "long").add("weight", "long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for rows, texts, again in _batches(b.column(1)):
                doc, bucket = features(texts, again, buckets)
                n[rows] += np.bincount(doc, minlength=len(rows))
                # whole numbers below 2^53, so their sums are exact
                total[rows] += np.bincount(doc, gain[bucket], len(rows)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(total // np.maximum(n, 1))], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank counts the drawn from the highest score and is null for others.

    share percent of the rows with at least least words are drawn. Ties go to the smaller doc_id, rows without one come after those;
    repeated rows are rows of their own. A null text has no words, an empty target no counts. Other columns take no part.
    """
    gain = gains(_vector(bucket_counts(docs, "text", buckets), buckets), _vector(bucket_counts(target, "text", buckets), buckets))
    scored = stage(weigh(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample-scores")
    eligible = F.col("n_features") >= 2 * least - 1  # w words have 2 w - 1 features
    able = scored.where(eligible)
    drawn = able.count() * share // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    ranked = running(able, order, name="rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def take(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents drawn, with all their columns; doc_id must be unique and not null."""
    chosen = resample(docs, target, **options).where("rank IS NOT NULL").select("doc_id")
    return docs.join(chosen, "doc_id", "left_semi")


#: crc32 is folded over a feature's bytes with a table of 256 entries.
ORACLE = r"""
WITH steps AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), split AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), grams AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM split
), counted AS (
  SELECT side, id, f, count(*) AS m FROM grams GROUP BY ALL
), hashed AS (
  SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f, hex(encode(f)) AS x FROM counted), steps
), sums AS (
  SELECT bucket, coalesce(sum(m) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(m) FILTER (side = 'b'), 0)::DOUBLE AS t FROM counted JOIN hashed USING (f) GROUP BY 1
), totals AS (
  SELECT coalesce(sum(s), 0)::DOUBLE AS big_s, coalesce(sum(t), 0)::DOUBLE AS big_t FROM sums
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000))))::BIGINT AS g FROM sums, totals
), weights AS (
  SELECT id, sum(m)::BIGINT AS n, floor(sum(m * g)::DOUBLE / sum(m))::BIGINT AS w FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1
), scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(w, 0)::BIGINT AS weight,
    (coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM documents LEFT JOIN weights ON id = doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 39 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY n_features >= 39) AS c FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 39 AND k <= 25 * c // 100 THEN k END::BIGINT AS rank FROM ranked
"""
