"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path, shared_dir, stage

__all__ = ["U64", "fresh_path", "mix", "parts", "release", "rolling", "shared_dir", "spans", "stage", "strings", "table", "text_bytes", "unused", "word_hashes", "words"]

U64 = np.uint64

# Bytes that separate words: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of frames that nothing refers to any more, now that their result is stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column, one scan and one long."""
    return df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def unused(columns: list[str], name: str) -> str:
    """A column name like name that none of the columns has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8) if off is not None and off.size else np.zeros(n + 1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most limit bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the index of its first word (n + 1 long)."""
    if not len(flat):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (xor-shift and multiply)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def lanes(seed: int) -> tuple[np.ndarray, int]:
    """Random 64-bit byte values (zero for separators) and an odd multiplier."""
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 2**64, 256, dtype=U64)
    values[SPACE] = 0
    return values, int(rng.integers(0, 2**63)) * 2 + 1


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(flat: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of every word, by position-weighted sums of random byte values."""
    if not len(starts):
        return np.zeros(0, U64)
    values, base = lanes(seed)
    lengths = np.diff(starts, append=len(flat))
    at = np.arange(starts[0], len(flat)) - np.repeat(starts, lengths)
    weighed = values[flat[starts[0] :]] * powers(base, int(lengths.max()))[at]
    return mix(np.add.reduceat(weighed, starts - starts[0]))


def rolling(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every window of width words, by doubling; windows may cross rows, the caller masks those."""
    if len(h) < width:
        return np.zeros(0, U64)
    _, base = lanes(seed)
    power, have, out, got = base, h, None, 0
    size, rest = 1, width
    mod = 1 << 64
    while rest:
        if rest & 1:
            out, got = (have, size) if out is None else (out[: len(h) - got - size + 1] + U64(pow(base, got, mod)) * have[got : len(h) - size + 1], got + size)
        rest >>= 1
        if rest:
            have = have[: len(have) - size] + U64(power) * have[size:]
            size, power = size * 2, power * power % mod
    return mix(out)
