"""Secrets in texts: fixed forms, and tokens that pass a battery of randomness tests.

Assignments, access keys and long hexadecimal runs are found by their form. Beyond those, a token of 20 or more characters
whose alphabet tells an encoding (hexadecimal, base32, base36, base64) is tested as a sequence of digits of that
encoding: chi-squared of the alphabet's use, runs above and below its middle, and serial correlation of neighbours. Its statistic is the
largest deviation of the three; a random token has a small one.

How small a statistic is too small for ordinary text depends on length, and is learned from the corpus: every document's other
characters in an encoding's alphabet, end to end, are cut to lengths from 20 to 256 and tested alike. A token's p-value is
the share of such pieces at least as random, the least of those of its own length and shorter ones (longer pieces are told apart better, so each is an upper
bound), and Benjamini and Hochberg's step over all tokens of the corpus bounds the share of ordinary ones among those reported. What is neither
ordinary nor random (a repeated pattern, say) is not reported either. Only
counts by encoding, length and statistic leave a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import spans, strings

WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
BASE = ("assign", "access", "hex")
ENCODINGS = ("hex", "base32", "base36", "base64")
SIZES = np.array([16, 32, 36, 64])
KINDS = (*BASE, *(f"random_{e}" for e in ENCODINGS))
#: Lengths to which ordinary text is cut; a token is judged as the longest that it reaches.
LENGTHS = np.array([20, 24, 28, 32, 40, 48, 64, 96, 128, 192, 256])
#: The statistic in tenths; larger ones count as the last.
BINS = 400
#: The share of ordinary tokens among those reported, and the deviation beyond which a token is not taken for random (one random token in 5,000).
RATE, CEILING = 0.01, 4.0
BATCH = 2 << 20


def _table(pairs: list[bytes]) -> np.ndarray:
    """A byte's value in an alphabet, -1 outside; further strings give more bytes for the same values."""
    out = np.full(256, -1, np.int8)
    for letters in pairs:
        out[np.frombuffer(letters, np.uint8)] = np.arange(len(letters))
    return out


UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
VALUES = np.stack([_table([DIGITS + b"abcdef", DIGITS + b"ABCDEF"]), _table([UPPER + b"234567"]), _table([DIGITS + LOWER, DIGITS + UPPER]), _table([UPPER + LOWER + DIGITS + b"+/", UPPER + LOWER + DIGITS + b"-_"])])
#: What ordinary text gives to each: one case of letters, so that it is not mixed.
PLAIN = np.stack([_table([DIGITS + b"abcdef"]), VALUES[1], _table([DIGITS + LOWER]), VALUES[3]])
HEX, TOKEN = np.zeros(256, bool), VALUES[3] >= 0
HEX[np.frombuffer(DIGITS + b"abcdef", np.uint8)] = True
#: Kinds of characters as bits: digits in base32 and other ones, letters up to f and beyond in both cases, the two pairs of signs.
LOW_DIGIT, DIGIT, AF, GZ, UPPER_AF, UPPER_GZ, SIGNS, URL_SIGNS = (1 << k for k in range(8))
BITS = np.zeros(256, np.uint8)
for _bit, _letters in ((LOW_DIGIT, b"234567"), (DIGIT, b"0189"), (AF, LOWER[:6]), (GZ, LOWER[6:]), (UPPER_AF, UPPER[:6]), (UPPER_GZ, UPPER[6:]), (SIGNS, b"+/"), (URL_SIGNS, b"-_")):
    BITS[np.frombuffer(_letters, np.uint8)] = _bit


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true."""
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def encoding(bits: np.ndarray) -> np.ndarray:
    """The encoding that the kinds of characters of a token tell, -1 without any: letters and digits must be there, of both cases for base64."""
    has = lambda *kinds: (bits & sum(kinds)) > 0
    digit, lower, upper, signs = has(LOW_DIGIT, DIGIT), has(AF, GZ), has(UPPER_AF, UPPER_GZ), has(SIGNS, URL_SIGNS)
    one_case = digit & (lower ^ upper) & ~signs
    out = np.where(digit & lower & upper & ~(has(SIGNS) & has(URL_SIGNS)), 3, -1)
    out = np.where(one_case, 2, out)
    out = np.where(one_case & ~lower & ~has(DIGIT), 1, out)
    return np.where(one_case & ~has(GZ, UPPER_GZ), 0, out)


def battery(values: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """The largest absolute deviation of three tests of each sequence, sequences end to end with digits below size; each is about standard normal if digits are random."""
    n, total = lengths.astype(float), len(lengths)
    which = np.repeat(np.arange(total), lengths)
    counts = np.bincount(which * size + values, minlength=total * size).reshape(total, size)
    chi = (counts * counts).sum(1) * (size / n) - n
    df = size - 1.0
    uniform = (np.cbrt(chi / df) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    same = which[1:] == which[:-1]  # neighbours within a sequence
    pair, left = which[1:][same], n - 1
    high = 2 * values >= size
    changes = np.bincount(pair, (high[1:] != high[:-1])[same], total)
    centred = values - df / 2
    product = np.bincount(pair, (centred[1:] * centred[:-1])[same], total)
    turns = (changes - left / 2) / np.sqrt(left / 4)
    serial = product / ((size * size - 1) / 12) / np.sqrt(left)
    return np.abs(np.stack([uniform, turns, serial])).max(0)


def bins(statistic: np.ndarray) -> np.ndarray:
    return np.minimum(statistic * 10, BINS - 1).astype(np.int64)


CYCLE = np.zeros(int(LENGTHS.sum()), bool)
CYCLE[np.cumsum(LENGTHS) - LENGTHS] = True
PIECE = np.repeat(np.arange(len(LENGTHS)), LENGTHS)


class Batch:
    """Documents joined with zero bytes, which no form and no token holds."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\0".join([*texts, b""])
        self.flat = np.frombuffer(self.data, np.uint8)
        self.offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        start, end = runs(TOKEN[self.flat])
        long = end - start >= LENGTHS[0]
        start, end = start[long], end[long]
        kinds = np.array([np.bitwise_or.reduce(BITS[self.flat[a:b]]) for a, b in zip(start, end, strict=True)], np.uint8)
        code = encoding(kinds)
        self.start, self.end, self.code = start[code >= 0], end[code >= 0], code[code >= 0]
        self.length = np.searchsorted(LENGTHS, self.end - self.start, "right") - 1
        self.bin = np.zeros(len(self.start), np.int64)
        for e in range(len(ENCODINGS)):
            mine = np.flatnonzero(self.code == e)
            if len(mine):
                values = np.concatenate([VALUES[e][self.flat[self.start[i] : self.end[i]]] for i in mine]).astype(np.int64)
                self.bin[mine] = bins(battery(values, (self.end - self.start)[mine], int(SIZES[e])))

    def ordinary(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(encoding, length, bin) of the pieces of what is no token."""
        free = np.ones(len(self.flat), bool)
        for a, b in zip(self.start, self.end, strict=True):
            free[a:b] = False
        for e in range(len(ENCODINGS)):
            at = np.flatnonzero((PLAIN[e][self.flat] >= 0) & free)
            if not len(at):
                continue
            first = np.searchsorted(at, self.offsets)  # of each document, and the end
            place = np.arange(len(at)) - np.repeat(first[:-1], np.diff(first))
            begin = np.flatnonzero(CYCLE[place % len(CYCLE)])
            lengths = np.diff(begin, append=len(at))
            piece = PIECE[place[begin] % len(CYCLE)]
            whole = lengths == LENGTHS[piece]  # others are cut short by their document's end
            at = at[np.repeat(whole, lengths)]
            yield e, piece[whole], bins(battery(PLAIN[e][self.flat[at]].astype(np.int64), lengths[whole], int(SIZES[e])))

    def base(self) -> Iterator[tuple[int, int, int]]:
        """(kind, start, end) of the fixed forms, bytes of the batch."""
        low, hits = self.data.lower(), []
        for w in WORDS:
            at = low.find(w)
            while at >= 0:
                hits.append(at)
                at = low.find(w, at + 1)
        done = 0
        for at in sorted(hits):
            if at >= done and (m := ASSIGN.match(self.data, at)):
                done = m.end()
                if len(m[2]) >= 8:
                    yield 0, m.start(), m.end()
        for m in ACCESS.finditer(self.data):
            if len(m[0]) >= 16:
                yield 1, m.start(), m.end()
        start, end = runs(HEX[self.flat])
        long = end - start >= 32
        for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True):
            yield 2, a, b

    def found(self, accepted: np.ndarray) -> dict[int, list[tuple[int, int, int, float | None]]]:
        """(start, kind, end, statistic) in code points by document, in order: all forms, and accepted tokens that no form covers."""
        base = sorted((a, b, k) for k, a, b in self.base())
        out = [(a, k, b, None) for a, b, k in base]
        ends = np.maximum.accumulate(np.array([b for _, b, _ in base], np.int64)) if base else np.zeros(0, np.int64)
        for i in np.flatnonzero(accepted[self.code, self.length, self.bin]):
            a, b = int(self.start[i]), int(self.end[i])
            before = int(np.searchsorted(np.array([x for x, _, _ in base], np.int64), a, "right"))
            if not (before and ends[before - 1] >= b):  # a form that begins no later and ends no earlier
                out.append((a, len(BASE) + int(self.code[i]), b, float(self.bin[i]) / 10))
        if not out:
            return {}
        points = np.concatenate([[0], np.cumsum((self.flat & 0xC0) != 0x80)])
        rows: dict[int, list[tuple[int, int, int, float | None]]] = {}
        for a, k, b, s in sorted(out, key=lambda x: x[:3]):
            doc = int(np.searchsorted(self.offsets, a, "right")) - 1
            origin = points[self.offsets[doc]]
            rows.setdefault(doc, []).append((int(points[a] - origin), k, int(points[b] - origin), s))
        return rows


def _batches(column: pa.Array) -> Iterator[tuple[int, Batch]]:
    flat, offsets = strings(column)
    for lo, hi in spans(offsets, BATCH):
        yield lo, Batch([flat[a:b].tobytes() for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)])


SHAPE = (2, len(ENCODINGS), len(LENGTHS), BINS)


def statistics(docs: DataFrame) -> DataFrame:
    """(cell, n): tokens and ordinary pieces by encoding, length and statistic, over all documents; a few ten thousand cells at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SHAPE, np.int64)
        for b in batches:
            for _, batch in _batches(b.column(0)):
                np.add.at(total, (0, batch.code, batch.length, batch.bin), 1)
                for e, length, bin_ in batch.ordinary():
                    cells = np.bincount(length * BINS + bin_, minlength=len(LENGTHS) * BINS)
                    total[1, e] += cells.reshape(len(LENGTHS), BINS)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["cell", "n"])

    return docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def accept(tokens: np.ndarray, ordinary: np.ndarray, rate: float = RATE) -> np.ndarray:
    """Which (encoding, length, bin) are reported: Benjamini and Hochberg's step over all tokens."""
    upto = ordinary.cumsum(2)
    p = (1 + upto) / (1 + upto[:, :, -1:])
    p = np.minimum.accumulate(p, 1)  # longer ones are told apart at least as well
    order = np.argsort(p, axis=None, kind="stable")
    sorted_p, upto_tokens = p.ravel()[order], tokens.ravel()[order].cumsum()
    # cells of equal p stand or fall together
    last = np.searchsorted(sorted_p, sorted_p, "right") - 1
    good = np.flatnonzero((sorted_p * max(int(tokens.sum()), 1) <= rate * upto_tokens[last]) & (upto_tokens[last] > 0))
    random_enough = np.arange(BINS) < CEILING * 10
    return (p <= sorted_p[good[-1]]) & random_enough if len(good) else np.zeros(p.shape, bool)


def thresholds(docs: DataFrame, rate: float = RATE) -> np.ndarray:
    counts = np.zeros(SHAPE, np.int64)
    for r in statistics(docs).collect():
        counts.ravel()[r.cell] = r.n
    return accept(counts[0], counts[1], rate)


SPANS = "array<struct<kind:string,start:long,end:long,statistic:double>>"


def scan(docs: DataFrame, rate: float = RATE, accepted: np.ndarray | None = None) -> DataFrame:
    """(doc_id, spans): every row with its secrets in order of start, in code points; statistic is null for fixed forms.

    Which random tokens are reported depends on all texts, unless accepted is given (from ``thresholds`` of a corpus, say). Null and
    empty texts have none; repeated rows and rows without doc_id are scanned like others. Other columns take no part.
    """
    accepted = thresholds(docs, rate) if accepted is None else accepted
    schema = docs.select("doc_id", F.lit(None).cast(SPANS).alias("spans")).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for lo, batch in _batches(b.column(1)):
                for doc, found in batch.found(accepted).items():
                    rows[lo + doc] = [{"kind": KINDS[k], "start": a, "end": e, "statistic": s} for a, k, e, s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, arrow.field("spans").type)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs, rate).select("doc_id", *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
