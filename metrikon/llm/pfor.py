"""Token ids in patched frame-of-reference blocks.

A segment is one binary value: a header, an index with the byte at which each block
begins, the documents' token counts, then the blocks. A block of ``BLOCK`` ids keeps
its minimum, the bit width that holds ``PERCENTILE`` per cent of the differences to
it, the packed low bits, and an exception list of positions and values for the rest.
Segments of a table are written in ascending doc_id order through Spark's own writer.
"""

from __future__ import annotations

import array
import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import fresh_path, parts, text_bytes

BLOCK, PERCENTILE = 512, 95
MAGIC = b"PFB1"
HEAD = struct.Struct("<4sIII")
BLOCK_HEAD = struct.Struct("<IHBH")
HEAD_FIELDS = np.dtype([("least", "<u4"), ("n", "<u2"), ("width", "u1"), ("out", "<u2")])
SEGMENT_IDS = 1 << 20
#: Blocks packed or unpacked at a time.
ROWS = 32
FILE = "part int, at long, n long, nulls int, doc_ids binary, segment binary"
# The split of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts of PLAIN characters only, on which both engines' classes agree; this engine is faster.
PLAIN_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
PLAIN = re.compile("[\0-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027]*")
_split = regex.compile(SPLIT).findall
#: A space that does not begin a piece.
LOOSE = re.compile(r" (?:\s|\Z)").search
#: Signs that are a piece of their own behind a word.
SIGNS = frozenset(".,;:!?)")
#: Longer pieces and chunks are not cached.
LONGEST = 64


def split(text: str) -> list[str]:
    return PLAIN_SPLIT.findall(text) if PLAIN.fullmatch(text) else _split(text)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Of each row of unsigned 32-bit values the low width bits, highest bit first, as a row of bytes."""
    if not width:
        return np.zeros((len(values), 0), np.uint8)
    octets = (width + 7) // 8
    low = np.ascontiguousarray(values.astype(">u4").view(np.uint8).reshape(*values.shape, 4)[..., 4 - octets :])
    if width % 8:
        bits = np.unpackbits(low, axis=-1).reshape(*values.shape, 8 * octets)[..., 8 * octets - width :]
        return np.packbits(bits.reshape(len(values), -1), axis=1)
    return low.reshape(len(values), -1)


@functools.cache
def _places(width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n packed values the byte in which it begins and the shift that brings its last bit to the end of 32."""
    at = np.arange(n) * width
    return at // 8, (32 - width - at % 8).astype(np.uint32)


def unpack(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    """The inverse: rows of n values."""
    if width % 8 == 0 or width > 25:  # whole bytes, or values that can lie in five
        bits = np.zeros((len(packed), n, 32), np.uint8)
        bits[..., 32 - width :] = np.unpackbits(packed, axis=1, count=n * width).reshape(len(packed), n, width)
        return np.packbits(bits, axis=-1).view(">u4")[..., 0].astype(np.uint32) if width != 16 else packed.view(">u2").astype(np.uint32)
    at, shift = _places(width, n)
    wide = np.zeros((len(packed), packed.shape[1] + 4), np.uint32)
    wide[:, : packed.shape[1]] = packed
    wide = wide[:, :-3] << np.uint32(24) | wide[:, 1:-2] << np.uint32(16) | wide[:, 2:-1] << np.uint32(8) | wide[:, 3:]
    return wide[:, at] >> shift & np.uint32((1 << width) - 1)


def _blocks(part: np.ndarray) -> list[bytes]:
    """Encoded blocks of equally long rows of ids; rows of one width are packed together."""
    rows, n = part.shape
    least = part.min(1)
    rest = part - least[:, None]
    k = min(n - 1, n * PERCENTILE // 100)
    # bits of the value below which the wanted share lies
    width = np.frexp(np.partition(rest, k, axis=1)[:, k].astype(np.float64))[1]
    out: list[bytes] = [b""] * rows
    groups = ((w, every[i : i + ROWS]) for w in np.unique(width).tolist() for every in [np.flatnonzero(width == w)] for i in range(0, len(every), ROWS))
    for w, mine in groups:
        packed = pack(rest[mine], w)
        beyond = rest[mine] >> np.uint32(w) if w < 32 else np.zeros((len(mine), n), np.uint32)
        row, place = np.nonzero(beyond)
        value, place = rest[mine[row], place].astype("<u4"), place.astype("<u2")
        ends = np.searchsorted(row, np.arange(len(mine) + 1)).tolist()
        for i, (at, x) in enumerate(zip(mine.tolist(), packed, strict=True)):
            lo, hi = ends[i], ends[i + 1]
            out[at] = BLOCK_HEAD.pack(int(least[at]), n, w, hi - lo) + x.tobytes() + place[lo:hi].tobytes() + value[lo:hi].tobytes()
    return out


def encode_segment(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """ids: uint32; counts: tokens of each document."""
    full = len(ids) // BLOCK
    blocks = _blocks(ids[: full * BLOCK].reshape(full, BLOCK)) if full else []
    if len(ids) % BLOCK:
        blocks += _blocks(ids[None, full * BLOCK :])
    index = np.cumsum([0, *map(len, blocks)])[:-1] if blocks else np.zeros(0, np.int64)
    return HEAD.pack(MAGIC, len(ids), len(index), len(counts)) + index.astype("<u8").tobytes() + counts.astype("<u4").tobytes() + b"".join(blocks)


class Segment:
    """Reads a segment; block(k) reads one block through the index alone."""

    def __init__(self, data: bytes):
        magic, self.n, self.n_blocks, n_docs = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block file")
        at = HEAD.size
        self.index = np.frombuffer(data, "<u8", self.n_blocks, at).astype(np.int64)
        self.counts = np.frombuffer(data, "<u4", n_docs, at + 8 * self.n_blocks).astype(np.int64)
        self.data, self.begin = np.frombuffer(data, np.uint8), at + 8 * self.n_blocks + 4 * n_docs

    def block(self, k: int) -> np.ndarray:
        return self.blocks(np.array([k]))

    def ids(self) -> np.ndarray:
        return self.blocks(np.arange(self.n_blocks))

    def blocks(self, which: np.ndarray) -> np.ndarray:
        """The ids of some blocks, one after the other; those of one length and width are unpacked together."""
        if not len(which):
            return np.zeros(0, np.uint32)
        at = self.begin + self.index[which]
        head = np.ascontiguousarray(sliding_window_view(self.data, BLOCK_HEAD.size)[at]).view(HEAD_FIELDS)[:, 0]
        size, width = head["n"].astype(np.int64), head["width"].astype(np.int64)
        out = np.zeros((len(which), int(size.max())), np.uint32)
        after = at + BLOCK_HEAD.size
        for n, w in {*zip(size.tolist(), width.tolist(), strict=True)}:
            every = np.flatnonzero((size == n) & (width == w))
            for mine in (every[i : i + ROWS] for i in range(0, len(every), ROWS) if w):
                out[mine, :n] = unpack(sliding_window_view(self.data, (n * w + 7) // 8)[after[mine]], w, n)
        after = after + (size * width + 7) // 8
        for k in np.flatnonzero(head["out"]).tolist():
            m, lo = int(head["out"][k]), int(after[k])
            place, value = self.data[lo : lo + 2 * m].view("<u2"), self.data[lo + 2 * m : lo + 6 * m].view("<u4")
            out[k, place] = value
        out += head["least"].astype(np.uint32)[:, None]
        return out.ravel()[: size.sum()] if (size[:-1] == out.shape[1]).all() else out[np.arange(out.shape[1]) < size[:, None]]


class _Pieces(dict):
    """Ids of a piece as bytes; a piece that is not there goes through the library's model."""

    def __init__(self, library, letters: list[str]):
        super().__init__()
        self.tokenize, self.letters = library.model.tokenize, dict(enumerate(letters))

    def ids(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # of these only the space has another letter
            mapped = piece.replace(" ", self.letters[32])
        else:
            mapped = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return array.array("I", [t.id for t in self.tokenize(mapped)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.ids(piece)
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class _Chunks(dict):
    """Ids of what follows a space, that space included. A word with a sign behind it is kept once its word has been met before."""

    def __init__(self, pieces: _Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > LONGEST or max(chunk) > "\u024f":
            return b"".join(map(self.pieces.__getitem__, split(" " + chunk)))
        if chunk.isalpha():
            self[chunk] = ids = self.pieces.ids(" " + chunk)
            return ids
        word, sign = chunk[:-1], chunk[-1]
        if sign in SIGNS and word.isalpha():
            known = word in self
            ids = self[word] + self.pieces[sign]
        else:
            first, *rest = split(" " + chunk)
            known, ids = True, b"".join([self[first[1:]] if first[1:].isalpha() else self.pieces[first], *map(self.pieces.__getitem__, rest)])
        if known:
            self[chunk] = ids
        return ids


class Encoder:
    """Ids of texts by the tokenizers library, as little-endian unsigned 32-bit integers.

    The library's byte-level split is a fixed pattern. A space before a letter, digit or sign begins a
    piece wherever it stands, so a text whose spaces are all of that kind is cut at them first, and what
    lies between is encoded once while it is cached. Pieces go through the library's model; texts that
    hold one of its special tokens go through the library as they are.
    """

    def __init__(self, path: str, room: int = 500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cache, self.room = _Pieces(self.library, byte_letters()), room
        self.chunks = _Chunks(self.cache)

    def encode(self, text: str) -> bytes:
        for cache, room in ((self.cache, self.room // 4), (self.chunks, self.room)):
            if len(cache) > room:
                cache.clear()
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if LOOSE(text):
            return b"".join(map(self.cache.__getitem__, split(text)))
        first, *rest = text.split(" ")
        return b"".join([*map(self.cache.__getitem__, split(first)), *map(self.chunks.__getitem__, rest)])


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process, which keeps its cache from task to task."""
    return Encoder(path)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = 2, part_bytes: int = 32 << 20) -> None:
    """Writes the segments of all texts in ascending doc_id order: (part, at, n, nulls, doc_ids, segment) with the
    number of the part, the ids of the part before the segment, those in it and its rows without doc_id.

    Null texts are empty and hold the end id alone. Rows with equal doc_id follow by a hash of their texts; rows
    without doc_id come first; other columns are ignored. The order is dealt by ranges of doc_id and
    hash, so that rows of one doc_id can lie in several parts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n = parts(text_bytes(docs), part_bytes, 12)
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, data, size = [], [], 0

        def segment() -> pa.RecordBatch:
            nonlocal at, ids, data, size
            counts = np.array([len(x) // 4 for x in data], np.int64)
            body, nulls = encode_segment(np.frombuffer(b"".join(data), "<u4"), counts), ids.count(None)
            row = {"part": part, "at": at, "n": int(counts.sum()), "nulls": nulls, "doc_ids": np.array(ids[nulls:], "<i8").tobytes(), "segment": body}
            at, ids, data, size = at + int(counts.sum()), [], [], 0
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("nulls", pa.int32()), ("doc_ids", pa.binary()), ("segment", pa.binary())]))

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                names, texts = (b.column(k).slice(lo, 256).to_pylist() for k in (0, 1))
                for name, text in zip(names, texts, strict=True):
                    ids.append(name)
                    data.append((x := coder.encode(text)) + last)
                    size += len(x) // 4 + 1
                    if size >= SEGMENT_IDS:
                        yield segment()
        if ids:
            yield segment()

    ordered = docs.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    ordered.mapInArrow(run, FILE).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark, path: str, keep: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) or, without keep, (doc_id, start, n_tokens, ids_crc32) from the files."""
    files = spark.read.schema(FILE).parquet(path)
    # One row for each written part, not for each document: 12 bytes for each part_bytes of text, 40 MB at 100 TB.
    sizes = files.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").toArrow()
    names, counts = (sizes[c].to_numpy() for c in ("part", "n"))
    shared = spark.sparkContext.broadcast((names, np.cumsum(counts) - counts))
    last, kind = ("ids", "binary") if keep else ("ids_crc32", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_, before = shared.value
        for b in batches:
            for r in b.to_pylist():
                segment = Segment(r["segment"])
                ends = np.cumsum(segment.counts)
                data, begin = memoryview(segment.ids().astype("<u4").tobytes()), ends - segment.counts
                found = [data[4 * i : 4 * j] for i, j in zip(begin.tolist(), ends.tolist(), strict=True)]
                found = pa.array([bytes(x) for x in found], pa.binary()) if keep else pa.array([zlib.crc32(x) for x in found], pa.int64())
                ids = pa.concat_arrays([pa.nulls(r["nulls"], pa.int64()), pa.array(np.frombuffer(r["doc_ids"], "<i8"))])
                yield pa.RecordBatch.from_arrays([ids, pa.array(begin + r["at"] + before[np.searchsorted(parts_, r["part"])]), pa.array(segment.counts), found], ["doc_id", "start", "n_tokens", last])

    return files.drop("n").mapInArrow(run, f"doc_id long, start long, n_tokens long, {last} {kind}")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path)
    return read_tokens(docs.sparkSession, path, keep=False)
