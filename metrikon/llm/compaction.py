"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small shards in folders of their own. A compaction takes
runs whose sizes lie in one tier (sizes within a factor of each other), merges each
full tier into files of the target size, and commits the next manifest. A manifest
is a JSON file named by its version: it is written aside whole and then gets its name
in one step that fails if another writer has taken it: a hard link on local disks, a
rename elsewhere, which a Hadoop file system refuses if the name exists. (Object stores
whose rename replaces need a table format with its own commit service.) Readers see the
old list or the new one. Shards are never changed, and those that no manifest names can go.

Only DataFrame operations move rows. The manifest lists runs, not rows.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, unused


@dataclass(frozen=True)
class Run:
    """One immutable folder of shards."""

    path: str
    bytes: int
    files: int
    level: int


class Conflict(Exception):
    """Another writer committed the version first."""


class ShardStore:
    """Append, compact and read a table of shards at a path that all machines share."""

    def __init__(self, spark: SparkSession, path: str, schema, target_bytes: int = 64 << 20, fanout: int = 4, smallest: int = 1 << 20):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.target, self.fanout, self.smallest = target_bytes, fanout, smallest
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))

    def version(self) -> int:
        """The latest committed version; 0 before any."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/manifests"))]
        return max([0, *(int(n[1:9]) for n in names if n.endswith(".json") and n.startswith("v"))])

    def runs(self, version: int | None = None) -> list[Run]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.path}/manifests/v{version:08d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(**r) for r in json.loads(text)["runs"]]

    def commit(self, runs: list[Run], base: int) -> int:
        """Publishes runs as version base + 1, or raises Conflict."""
        aside, name = (self._path(f"{self.path}/manifests/{x}") for x in (f".{uuid.uuid4().hex}", f"v{base + 1:08d}.json"))
        out = self._fs.create(aside, False)
        out.write(json.dumps({"version": base + 1, "runs": [asdict(r) for r in runs]}).encode())
        out.close()
        if not self._publish(aside, name):
            self._fs.delete(aside, False)
            raise Conflict(name.toString())
        return base + 1

    def _publish(self, aside, name) -> bool:
        """Gives a file its name, or says that the name is taken."""
        if self._fs.getScheme() != "file":
            return not self._fs.exists(name) and self._fs.rename(aside, name)
        local = lambda p: self._fs.makeQualified(p).toUri().getPath()
        try:
            os.link(local(aside), local(name))  # a rename would replace
        except FileExistsError:
            return False
        self._fs.delete(aside, False)
        return True

    def _measure(self, path: str, level: int) -> Run:
        files = [s for s in self._fs.listStatus(self._path(path)) if s.getPath().getName().startswith("part-")]
        return Run(path, sum(s.getLen() for s in files), len(files), level)

    def append(self, df: DataFrame) -> Run:
        """One arrival as one run of small shards."""
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(path)
        run, base = self._measure(path, 0), self.version()
        self.commit([*self.runs(base), run], base)
        return run

    def append_split(self, df: DataFrame, arrival: str) -> list[Run]:
        """Many arrivals in one pass: a run for each value of the column arrival, which is not stored."""
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.partitionBy(arrival).parquet(path)
        folders = sorted(s.getPath().toString() for s in self._fs.listStatus(self._path(path)) if s.isDirectory())
        new, base = [self._measure(p, 0) for p in folders], self.version()
        self.commit([*self.runs(base), *new], base)
        return new

    def tier(self, run: Run) -> int:
        """Runs below the smallest size are one tier; above it sizes within a factor of fanout are."""
        return 0 if run.bytes < self.smallest else 1 + int(math.log(run.bytes / self.smallest, self.fanout))

    def due(self, runs: list[Run]) -> list[list[Run]]:
        """Groups to merge: tiers with at least fanout runs. Runs of well-filled files above the target stay."""
        tiers: dict[int, list[Run]] = {}
        for r in runs:
            if r.bytes < self.target or r.bytes / max(r.files, 1) < self.target / 2:
                tiers.setdefault(self.tier(r), []).append(r)
        return [sorted(g, key=lambda r: r.path) for _, g in sorted(tiers.items()) if len(g) >= self.fanout]

    def compact(self) -> int:
        """Merges until no tier is full, a version for each round; returns the last version. Each round leaves fewer runs."""
        while True:
            base = self.version()
            runs = self.runs(base)
            groups = self.due(runs)
            if not groups:
                return base
            merged = []
            for group in groups:
                path = f"{self.path}/data/{uuid.uuid4().hex}"
                rows = self.spark.read.schema(self.schema).parquet(*[r.path for r in group])
                rows.coalesce(max(1, math.ceil(sum(r.bytes for r in group) / self.target))).write.parquet(path)
                merged.append(self._measure(path, 1 + max(r.level for r in group)))
            gone = {r.path for g in groups for r in g}
            self.commit([*(r for r in runs if r.path not in gone), *merged], base)

    def vacuum(self, keep: int = 1, grace: float = 3600.0) -> None:
        """Deletes what none of the last keep versions names: older manifests, their runs, and data of commits that failed.

        Data younger than grace seconds may belong to a commit under way and stay.
        """
        last, before = self.version(), (time.time() - grace) * 1000
        kept = range(max(1, last - keep + 1), last + 1)
        live = {self._path(r.path).toUri().getPath() for v in kept for r in self.runs(v)}
        for s in self._fs.listStatus(self._path(f"{self.path}/manifests")):
            name = s.getPath().getName()
            if (name.startswith("v") and int(name[1:9]) < kept.start) or (not name.startswith("v") and s.getModificationTime() < before):
                self._fs.delete(s.getPath(), False)
        if not self._fs.exists(self._path(f"{self.path}/data")):
            return
        for folder in self._fs.listStatus(self._path(f"{self.path}/data")):
            own = folder.getPath().toUri().getPath()
            inside = {p for p in live if p == own or p.startswith(own + "/")}
            if not inside and folder.getModificationTime() <= before:
                self._fs.delete(folder.getPath(), True)
            elif inside and own not in inside:  # one folder of many arrivals
                for part in self._fs.listStatus(folder.getPath()):
                    if part.isDirectory() and part.getPath().toUri().getPath() not in inside:
                        self._fs.delete(part.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; no rows if nothing was committed."""
        paths = [r.path for r in self.runs(version)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)


ARRIVALS = 12


def compacted(docs: DataFrame, arrivals: int = ARRIVALS, **options) -> tuple[ShardStore, DataFrame]:
    """Documents dealt by a hash of doc_id into arrivals of unequal sizes, appended, compacted and read back.

    Rows come back as they were: nulls, repeated rows and any columns.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, fresh_path(spark, "shards"), docs.schema, **options)
    # arrival k of an even number has one half of the share of the next: two sizes, two tiers
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals * 3 // 2))
    name = unused(docs.columns, "_arrival")
    store.append_split(docs.withColumn(name, F.when(slot < arrivals, slot).otherwise((slot - arrivals) * 2)), name)
    store.compact()
    store.vacuum(grace=0)  # a store of its own: nobody else writes
    return store, store.read()


def digest(docs: DataFrame) -> DataFrame:
    _, rows = compacted(docs)
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "lang", "source", "n_chars")


ORACLE = "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256, lang, source, n_chars FROM documents"
