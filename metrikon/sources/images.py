"""What image files say of themselves: kind, width and height from their headers. Pixels are the detectors' matter."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import has_extension
from .tables import IMAGES

SIZES = pa.schema([("image_path", pa.string()), ("kind", pa.string()), ("image_width", pa.int32()), ("image_height", pa.int32())])


def size_of(data: bytes) -> tuple[str, int, int] | None:
    """(kind, width, height) of a PNG, JPEG or BMP file; none if the header is not whole."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24 and data[12:16] == b"IHDR":
        return "png", int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:2] == b"BM" and len(data) >= 26:
        return "bmp", int.from_bytes(data[18:22], "little", signed=True), abs(int.from_bytes(data[22:26], "little", signed=True))
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF:  # filling
            at += 1
        elif mark == 0x01 or 0xD0 <= mark <= 0xD7:
            at += 2
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return "jpeg", int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def dimensions(spark: SparkSession, folder: str) -> DataFrame:
    """(image_path, kind, image_width, image_height) of the images below a folder; nulls for files that cannot be read as images. Files without any byte have no row, as Spark lists none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *(size_of(d.as_py()) or (None, None, None))) for p, d in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(SIZES.names, r, strict=True)) for r in rows], SIZES)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(has_extension(F.col("path"), IMAGES))
    return files.select("path", "content").mapInArrow(run, "image_path string, kind string, image_width int, image_height int")
