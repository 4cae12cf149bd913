"""MPEG transport streams as a media column.

``mux`` stores a text's bytes losslessly as one private elementary stream: program
association and program map tables, PES packets with presentation time stamps, clock
references and random-access marks, cut into 188-byte packets. ``demux`` parses any
such column: it finds the packets again after junk or lost bytes, reads the program
tables, however many packets a section takes, with their checksums, checks continuity
counters by PID, reassembles the PES packets of every elementary stream, marks those
that lack packets, and returns time stamps with random-access points.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import fresh_path

PACKET, SYNC = 188, 0x47
PMT_PID, ES_PID, STREAM_TYPE, STREAM_ID = 0x100, 0x101, 0x06, 0xBD
# The stream ids whose units carry bytes right after their length, padding among them.
PLAIN, PADDING = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF), 0xBE
HEAD = 14  # PES header with a time stamp
FIRST = PACKET - 4 - 8  # room beside an adaptation field with a clock
UNIT_PACKETS = 17
UNIT = FIRST - HEAD + (UNIT_PACKETS - 1) * (PACKET - 4)
TICKS, RANDOM_ACCESS, TABLES = 3600, 8, 64  # clock ticks of a unit; units between random-access points and between tables
PAD = 192


def crc_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


@functools.cache
def _tables() -> tuple[np.ndarray, ...]:
    out = []
    pat = bytes([0, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255])
    pmt = bytes([2, 0xB0, 18, 0, 1, 0xC1, 0, 0, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0])
    for pid, section in ((0, pat), (PMT_PID, pmt)):
        body = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section + crc_mpeg(section).to_bytes(4, "big")
        out.append(np.frombuffer(body.ljust(PACKET, b"\xff"), np.uint8))
    return tuple(out)


def _stamp(pts: np.ndarray) -> np.ndarray:
    return np.stack([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 0xFE | 1, pts >> 7 & 255, pts << 1 & 0xFE | 1], 1).astype(np.uint8)


def _units(data: np.ndarray, unit: int, at: int) -> np.ndarray:
    """Packets of equally long access units; data: (units, bytes), unit: number of the first, at: packets before."""
    n, size = data.shape
    tail = max(0, size + HEAD - FIRST)
    count = 1 + -(-tail // (PACKET - 4))
    out = np.full((n, count, PACKET), 0xFF, np.uint8)
    number = unit + np.arange(n)
    cc = (at + np.arange(n * count)).reshape(n, count) & 15
    out[:, :, 0], out[:, :, 1], out[:, :, 2], out[:, :, 3] = SYNC, ES_PID >> 8, ES_PID & 255, 0x10 | cc
    out[:, 0, 1] |= 0x40
    out[:, 0, 3] |= 0x20
    pts = number * TICKS % (1 << 33)
    stuffed = max(0, FIRST - HEAD - size)
    out[:, 0, 4], out[:, 0, 5] = 7 + stuffed, np.where(number % RANDOM_ACCESS == 0, 0x50, 0x10)
    out[:, 0, 6:12] = np.stack([pts >> 25 & 255, pts >> 17 & 255, pts >> 9 & 255, pts >> 1 & 255, (pts & 1) << 7 | 0x7E, pts * 0], 1)
    begin = 12 + stuffed
    length = 8 + size
    out[:, 0, begin : begin + 9] = [0, 0, 1, STREAM_ID, length >> 8, length & 255, 0x80, 0x80, 5]
    out[:, 0, begin + 9 : begin + HEAD] = _stamp(pts)
    head = PACKET - begin - HEAD
    out[:, 0, begin + HEAD :] = data[:, :head]
    full = (size - head) // (PACKET - 4)
    if full:
        out[:, 1 : 1 + full, 4:] = data[:, head : head + full * (PACKET - 4)].reshape(n, full, PACKET - 4)
    left = (size - head) % (PACKET - 4)
    if left:
        stuff = PACKET - 4 - left
        out[:, -1, 3] |= 0x20
        out[:, -1, 4] = stuff - 1
        if stuff > 1:
            out[:, -1, 5] = 0
        out[:, -1, 4 + stuff :] = data[:, size - left :]
    return out.reshape(-1, PACKET)


def mux_bytes(payload: bytes) -> bytes:
    data, out, at = np.frombuffer(payload, np.uint8), [], 0
    units = -(-len(data) // UNIT)
    for k, unit in enumerate(range(0, max(units, 1), TABLES)):
        for t in _tables():
            t = t.copy()
            t[3] |= k & 15
            out.append(t[None])
        part = data[unit * UNIT : (unit + TABLES) * UNIT]
        full = len(part) // UNIT
        for rows in (part[: full * UNIT].reshape(full, UNIT), part[full * UNIT :][None]):
            if rows.size:
                out.append(_units(rows, unit, at))
                at += len(out[-1])
                unit += len(rows)
    return np.concatenate(out).tobytes()


@functools.lru_cache(4096)
def _valid(body: bytes) -> bool:
    return crc_mpeg(body) == 0


def _sections(rows: np.ndarray, start: np.ndarray, begins: np.ndarray, lost: np.ndarray) -> Iterator[bytes]:
    """Table sections of one PID's packets, whole and with a valid checksum; a section may go on over packets and share them."""
    held = b""
    for i in range(len(rows)):
        data = rows[i, start[i] :].tobytes()
        held = b"" if lost[i] else held
        if begins[i]:
            head = held + data[1 : 1 + data[0]] if held else b""
            yield from _whole(head)[0]
            found, held = _whole(data[1 + data[0] :])
        elif held:
            found, held = _whole(held + data)
        else:
            continue
        yield from found


def _whole(data: bytes) -> tuple[list[bytes], bytes]:
    """The sections at the beginning of data that are there whole, and what is left of the next."""
    out = []
    while len(data) >= 3 and data[0] != 0xFF:
        size = 3 + ((data[1] & 15) << 8 | data[2])
        if len(data) < size:
            return out, data
        if size > 11 and data[5] & 1 and _valid(data[:size]):  # in force now
            out.append(data[:size])
        data = data[size:]
    return out, b"" if data[:1] == b"\xff" else data


@functools.lru_cache(4096)
def _parsed(body: bytes) -> tuple[tuple[int, int], ...]:
    """Of a PAT (program, PID), of a PMT (stream type, PID)."""
    if body[0] == 0:
        return tuple((body[i] << 8 | body[i + 1], (body[i + 2] & 31) << 8 | body[i + 3]) for i in range(8, len(body) - 4, 4))
    if body[0] != 2:
        return ()
    out, i = [], 12 + ((body[10] & 15) << 8 | body[11])
    while i < len(body) - 8:
        out.append((body[i], (body[i + 1] & 31) << 8 | body[i + 2]))
        i += 5 + ((body[i + 3] & 15) << 8 | body[i + 4])
    return tuple(out)


def _packets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Where packets begin, which of them come after bytes that are none, and how many breaks there are.

    Packets follow each other by their sync bytes. After a break the next place counts from which three packets (or all up
    to the end) follow; a packet that this place cuts into is none.
    """
    n = len(data)
    if n % PACKET == 0 and (data[::PACKET] == SYNC).all():
        return np.arange(0, n, PACKET), np.zeros(n // PACKET, bool), 0
    sync = np.concatenate([data == SYNC, np.ones(2 * PACKET, bool)])  # beyond the end anything goes
    good = sync[:n] & sync[PACKET : PACKET + n] & sync[2 * PACKET : 2 * PACKET + n]
    good[max(n - PACKET + 1, 0) :] = False
    starts, after, breaks, at = [], [], 0, 0
    while at + PACKET <= n:
        if not sync[at] or not (starts or good[at]):
            ahead = np.flatnonzero(good[at:])
            if not len(ahead):
                break
            at, breaks = at + int(ahead[0]), breaks + 1
        run = sync[at : n - PACKET + 1 : PACKET]
        k = len(run) if run.all() else int(np.argmin(run))
        starts.append(at + PACKET * np.arange(k))
        after.append(np.arange(k) == 0)
        at += PACKET * k
        if k < len(run) or at < n:  # no packet follows: the last one may lack bytes
            last = at - PACKET
            ahead = np.flatnonzero(good[last + 1 : at])
            if len(ahead):
                starts[-1], after[-1] = starts[-1][:-1], after[-1][:-1]
                at = last + 1 + int(ahead[0])
                breaks += 1
                starts.append(np.array([at]))
                after.append(np.array([True]))
                at += PACKET
    breaks += at < n
    first = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    mark = np.concatenate(after) if after else np.zeros(0, bool)
    if len(mark):
        mark[0] = first[0] > 0
    return first, mark, breaks


def _repeated(rows: np.ndarray, mine: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Which packets of a PID repeat the one before: with its counter (same), equal to it but for the clock, and once. Others of that counter come after a loss."""
    out = np.zeros(len(same), bool)
    for i in np.flatnonzero(same):
        pair = rows[mine[i : i + 2]].copy()
        if pair[0, 3] & 0x20 and pair[0, 4] >= 7 and pair[0, 5] & 0x10:
            pair[:, 6:12] = 0
        out[i] = (pair[0] == pair[1]).all() and not (i and out[i - 1])
    return out


def _units_of(rows: np.ndarray, start: np.ndarray, begins: np.ndarray, field: np.ndarray, lost: np.ndarray, cut_off: bool = False) -> dict:
    """Payload, time stamps, random-access points and damaged units of one stream's packets, in order and without repetitions.

    cut_off says that packets after the last one could not be read. Units of the kinds in PLAIN have no header beyond their length; padding has no payload.
    """
    out = {"payload": b"", "pts": [], "random_access": [], "damaged": [], "errors": 0}
    if not begins.any():
        return out
    from_ = int(np.argmax(begins))  # what comes before the first start is left over from elsewhere
    rows, start, begins, field, lost = (x[from_:] for x in (rows, start, begins, field, lost))
    flat = rows[np.arange(PACKET) >= start[:, None]]
    ends = np.cumsum(PACKET - start)
    first = (ends - (PACKET - start))[begins]
    stop = np.append(first[1:], len(flat))
    marked = (field & (start > 5) & (rows[:, 5] & 0x40 > 0))[begins]
    unit = np.cumsum(begins) - 1
    harmed = np.zeros(len(first), bool)
    harmed[unit[lost & ~begins]] = True
    harmed[np.maximum(unit[lost & begins] - 1, 0)] |= unit[lost & begins] > 0  # packets lost before a start were its forerunner's
    harmed[-1] |= cut_off
    head = flat[np.minimum(first[:, None] + np.arange(14), len(flat) - 1)].astype(np.int64)
    plain = np.isin(head[:, 3], PLAIN)
    sane = (first + np.where(plain, 6, 9) <= stop) & (head[:, 0] == 0) & (head[:, 1] == 0) & (head[:, 2] == 1)
    length = head[:, 4] << 8 | head[:, 5]
    harmed |= (length > 0) & (first + 6 + length > stop)
    stop = np.where(length > 0, np.minimum(stop, first + 6 + length), stop)
    body = np.where(head[:, 3] == PADDING, stop, np.minimum(first + np.where(plain, 6, 9 + head[:, 8]), stop))
    keep = np.zeros(len(flat) + 1, np.int32)
    np.add.at(keep, body[sane], 1)
    np.add.at(keep, stop[sane], -1)
    timed = ~plain & (head[:, 7] & 0x80 > 0) & (head[:, 8] >= 5)
    pts = (head[:, 9] >> 1 & 7) << 30 | head[:, 10] << 22 | (head[:, 11] >> 1) << 15 | head[:, 12] << 7 | head[:, 13] >> 1
    return {"payload": flat[np.cumsum(keep[:-1]) > 0].tobytes(), "pts": np.where(timed, pts, -1)[sane].tolist(), "random_access": np.flatnonzero(marked[sane]).tolist(), "damaged": np.flatnonzero(harmed[sane]).tolist(), "errors": int((~sane).sum())}


def demux_bytes(media: bytes) -> dict:
    """Programs and streams, and of each stream its payload, time stamps, random-access points and damaged units.

    errors counts breaks of the packets' order, packets marked as faulty and units without a header; broken counts places where
    a counter jumps, or stands still although the packet is no repetition. A counter has 16 values, so a loss of a multiple of 16 packets shows only where
    units state their length. Scrambled packets are counted and left out. Units that lack packets keep what is left of them and are listed as damaged. A stream of bytes without
    valid tables has no elementary streams. payload, pts, random_access and damaged are those of the first.
    """
    data = np.frombuffer(media, np.uint8)
    at, after, errors = _packets(data)
    rows = data.reshape(-1, PACKET) if len(at) * PACKET == len(data) and not after.any() else data[at[:, None] + np.arange(PACKET)]
    good = rows[:, 1] & 0x80 == 0
    if not good.all():
        errors += int((~good).sum())
        after = after | np.concatenate([[False], ~good[:-1]])
        rows, after = rows[good], after[good]
    pid = (rows[:, 1].astype(np.int32) & 31) << 8 | rows[:, 2]
    begins = rows[:, 1] & 0x40 > 0
    field, carries = rows[:, 3] & 0x20 > 0, rows[:, 3] & 0x10 > 0
    start = 4 + np.where(field, 1 + rows[:, 4].astype(np.int32), 0)
    counter = rows[:, 3] & 15
    broken = repeats = 0
    again, lost = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    for p in np.unique(pid[carries]):
        mine = np.flatnonzero((pid == p) & carries & (p != 0x1FFF))
        step = (counter[mine[1:]].astype(int) - counter[mine[:-1]]) & 15
        twin = _repeated(rows, mine, step == 0)
        again[mine[1:][twin]] = True
        jump = field[mine[1:]] & (start[mine[1:]] > 5) & (rows[mine[1:], 5] & 0x80 > 0)  # a jump that the stream announces
        gap = (step != 1) & ~twin & ~jump
        lost[mine[1:][gap]] = True
        broken += int(gap.sum())
        repeats += int(twin.sum())
    # what is scrambled cannot be read: it is left out like a lost packet
    hidden = carries & (rows[:, 3] & 0xC0 > 0) & (pid != 0x1FFF)
    usable = carries & ~again & ~hidden & (start < PACKET)
    cut_off = set()
    for p in np.unique(pid[hidden]):
        mine = np.flatnonzero((pid == p) & carries & ~again)
        before = np.flatnonzero(hidden[mine[:-1]]) + 1
        lost[mine[before]] = True
        if hidden[mine[-1]]:
            cut_off.add(int(p))

    def tables(p: int) -> dict:
        mine = np.flatnonzero((pid == p) & usable)
        return {b: a for body in _sections(rows[mine], start[mine], begins[mine], lost[mine]) for a, b in _parsed(body)}

    programs = {p: k for p, k in tables(0).items() if k}
    streams = {e: kind for p in programs for e, kind in tables(p).items()}
    elementary = []
    for e, kind in streams.items():
        mine = np.flatnonzero((pid == e) & usable)
        found = _units_of(rows[mine], start[mine], begins[mine], field[mine], lost[mine], e in cut_off)
        errors += found.pop("errors")
        elementary.append({"pid": e, "kind": kind} | found)
    top = {k: elementary[0][k] for k in ("payload", "pts", "random_access", "damaged")} if elementary else {"payload": b"", "pts": [], "random_access": [], "damaged": []}
    return {"packets": len(at), "errors": errors, "broken": broken, "repeats": repeats, "scrambled": int(hidden.sum()), "programs": programs, "streams": streams, "elementary": elementary} | top


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b" " * (max(PAD, -(-len(data) // PAD) * PAD) - len(data))


def mux(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): a null text is an empty one; an empty one holds PAD spaces. Repeated rows and null ids stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                both = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in both], pa.int64()), pa.array([mux_bytes(x) for _, x in both], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


FIELDS = "packets int, errors int, broken int, repeats int, scrambled int, programs map<int,int>, streams map<int,int>"
UNITS = "pts array<long>, random_access array<int>, damaged array<int>"
STREAM = "struct<pid:int,kind:int,payload:binary,pts:array<bigint>,random_access:array<int>,damaged:array<int>>"


def demux(media: DataFrame, keep: bool = True) -> DataFrame:
    """Adds what ``demux_bytes`` finds: all elementary streams with their payloads or, without keep, the first one's digests. A null stream has nulls; other columns, null ids and repeated rows stay."""
    kept = media.drop("media").columns
    schema = ", ".join(f"`{c}` {t}" for c, t in media.drop("media").dtypes) + ", " + FIELDS
    schema += f", elementary array<{STREAM}>" if keep else f", {UNITS}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def row(stream: bytes | None) -> dict:
        if stream is None:
            return {}
        x = demux_bytes(stream)
        x |= {k: list(x[k].items()) for k in ("programs", "streams")}
        p = x.pop("payload")
        if not keep:
            x |= {"payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-16:]), "media_bytes": len(stream), "media_sha256": hashlib.sha256(stream).hexdigest()}
        return x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = [row(s.as_py()) for s in part.column("media")]
                yield pa.RecordBatch.from_arrays([*(part.column(c).cast(arrow.field(c).type) for c in kept), *(pa.array([r.get(f.name) for r in rows], f.type) for f in list(arrow)[len(kept) :])], schema=arrow)

    found = media.mapInArrow(run, schema)
    return found.withColumn("payload", F.get("elementary", F.lit(0))["payload"]) if keep else found


def stored(media: DataFrame) -> DataFrame:
    """The media column written to files of the shared folder and read back."""
    path = fresh_path(media.sparkSession, "media")
    media.write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.schema(media.schema).parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    """Features of stored media, with time stamps and random-access points."""
    x = demux(stored(mux(docs)), keep=False)
    pairs = lambda c: F.concat_ws(",", F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws(":", e["key"], e["value"])))
    stamps = F.crc32(F.concat_ws(",", F.transform("pts", lambda t: t.cast("string"))).cast("binary"))
    feature = F.concat_ws(";", F.concat(F.lit("packets="), "packets"), F.concat(F.lit("programs="), pairs("programs")), F.concat(F.lit("streams="), pairs("streams")), F.concat(F.lit("units="), F.size("pts")), F.concat(F.lit("last="), F.array_max("pts")), F.concat(F.lit("stamps="), stamps), F.concat(F.lit("access="), F.size("random_access")), F.concat(F.lit("damaged="), F.size("damaged")), F.concat(F.lit("broken="), "broken"), F.concat(F.lit("errors="), "errors"))
    return x.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "pts", "random_access")
