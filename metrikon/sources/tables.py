"""Measurement tables, image folders, and how results are stored."""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.ids import has_extension, subject_of, view_of

IMAGES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")


def two_row_header(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """CSVs whose first line holds bands and whose second holds names; all columns are text, names trimmed.

    Every file has a header of its own: files of one header are read together, and all are united by name, so that columns may come in any order and
    be missing in some. Exactly the first two lines of a file are its header; rows that equal it are data. A repeated name gets a
    number, an empty one its place. With quoted line breaks in cells, lines is false and a file is read by one task.
    """
    out = None
    for names, files in _headers(spark, path).items():
        part = _split_lines(spark, files, list(names)) if lines else _whole_files(spark, files, list(names))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no tables with two header lines at {path}")
    return out


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The distinct lists of names and their files; the first two lines of each file come to the driver."""
    out: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect()):
        cells = _first_lines(spark, file)
        if len(cells) == 2:
            out.setdefault(tuple(_unique(cells[1])), []).append(file)
    return out


def _first_lines(spark: SparkSession, file: str, n: int = 2) -> list[list[str]]:
    """The cells of the first lines of a file, read no further."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(file)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place), "UTF-8"))
    try:
        found = [reader.readLine() for _ in range(n)]
    finally:
        reader.close()
    return [_cells(line.removeprefix("\ufeff")) for line in found if line is not None]


def _unique(names: list[str]) -> list[str]:
    out: list[str] = []
    for i, n in enumerate(names):
        n = n or f"_c{i}"
        k, own = 1, n
        while own in out:
            own, k = f"{n}.{k}", k + 1
        out.append(own)
    return out


def _text_schema(names: list[str]) -> StructType:
    return StructType([StructField(f"_{i}", StringType()) for i in range(len(names))])


def _split_lines(spark: SparkSession, files: list[str], names: list[str]) -> DataFrame:
    """Files read in splits; the first two lines of the split that begins a file are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = None, 0
        for b in batches:
            keep = []
            for line, split in zip(b.column(0).to_pylist(), zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True), strict=True):
                if split != now:
                    now, left = split, 2 if split[1] == 0 else 0
                keep.append(left == 0 and bool(line.strip()))
                left = max(left - 1, 0)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))], ["value"])

    kept = spark.read.text(files).select("value", "_metadata.file_path", "_metadata.file_block_start").mapInArrow(run, "value string")
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "PERMISSIVE"}
    row = F.from_csv("value", F.lit(_text_schema(names).simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")), options)
    return kept.select(row.alias("r")).select("r.*").toDF(*names)


def _whole_files(spark: SparkSession, files: list[str], names: list[str]) -> DataFrame:
    """The same for files with line breaks in cells, each read by one task."""
    schema = ", ".join(f"_{i} string" for i in range(len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = [r for r in itertools.islice(csv.reader(io.StringIO(data.as_py().decode("utf-8-sig"), newline="")), 2, None) if any(c.strip() for c in r)]
                cells = [[r[i].strip() or None if i < len(r) else None for r in rows] for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cells], [f"_{i}" for i in range(len(names))])

    return spark.read.format("binaryFile").load(files).select("content").mapInArrow(run, schema).toDF(*names)


def _cells(line: str) -> list[str]:
    return [c.strip() for c in next(csv.reader([line]), [])]


def bands(spark: SparkSession, path: str) -> dict[str, str]:
    """The band of each column, carried on to the right; of a name in several files that of the first."""
    out: dict[str, str] = {}
    for file in sorted(r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect()):
        lines, last = _first_lines(spark, file), ""
        if len(lines) == 2:
            for b, n in zip(lines[0], _unique(lines[1]), strict=False):
                last = b or last
                out.setdefault(n, last)
    return out


def image_assets(spark: SparkSession, folder: str, site: str) -> DataFrame:
    """(subject_id, site, view, has_markers, image_path) of the images below a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    found = files.where(has_extension(F.col("path"), IMAGES))
    return found.select(subject_of(name).alias("subject_id"), F.lit(site).alias("site"), view_of(name).alias("view"), F.lower(name).contains("markers").alias("has_markers"), F.col("path").alias("image_path")).where("subject_id IS NOT NULL AND view IS NOT NULL")


def eligible(assets: DataFrame) -> DataFrame:
    """Images to calibrate: those of sites CO and BR, of ES with markers only."""
    return assets.where(F.col("site").isin("CO", "BR") | ((F.col("site") == "ES") & F.col("has_markers")))


def missing_views(assets: DataFrame, views: list[str], subject: str = "subject_id", view: str = "view") -> DataFrame:
    """Subjects that lack views, with those."""
    lacking = F.array_except(F.array(*map(F.lit, views)), F.collect_set(view))
    return assets.groupBy(subject).agg(F.array_sort(lacking).alias("missing")).where(F.size("missing") > 0)


def manifest(assets: DataFrame, accepted: DataFrame, folder: str, subject: str = "subject_id", path: str = "image_path") -> DataFrame:
    """(assets, target_path): where the images of accepted subjects belong, a folder for each subject; no file is moved."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    kept = assets.join(accepted.select(F.trim(F.col(subject).cast("string")).alias(subject)).distinct(), subject, "left_semi")
    return kept.select(*assets.columns, F.concat_ws("/", F.lit(folder.rstrip("/")), F.col(subject), name).alias("target_path"))


def first_images(assets: DataFrame, n: int) -> DataFrame:
    """The first n images in path order."""
    return assets.orderBy("image_path").limit(n)


def require(spark: SparkSession, paths: list[str]) -> None:
    """Raises FileNotFoundError that names every missing input."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    missing = [p for p in paths if not path(p).getFileSystem(conf).exists(path(p))]
    if missing:
        raise FileNotFoundError(", ".join(missing))


def store(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Writes a table in place of an earlier one; with by, in place of its partitions that df has rows of.

    So each site that is stored replaces itself alone, and a frame without rows replaces nothing. Partitions are swapped when the job
    commits, so a failed run leaves the earlier ones. A null is a partition of its own.
    """
    if not by:
        return df.write.mode("overwrite").parquet(path)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at path with the columns and types of schema; partitions' values are not guessed, so that a site 007 stays a text. Nothing stored yet is no rows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def store_csv(df: DataFrame, path: str) -> None:
    """A report, a table of some rows, as one CSV; an empty one keeps its header."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)
