"""Sharding with size-tiered compaction and versioned manifests."""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ensure_checkpoint_dir, table

TARGET_BYTES = 128 << 20
FANOUT = 4
LEAST_BYTES = 1 << 16
RUNS_A_ROUND = 256
#: Files that no version lists are left alone so long, in seconds: a writer may be about to commit them.
GRACE = 24 * 3600


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class Replaced(RuntimeError):
    """Another compaction has taken some of the shards."""


def merged_schema(old: T.StructType, new: T.StructType) -> T.StructType:
    """old's columns, then those that only new has, nullable; ValueError if a column has two types."""
    have = {f.name: f for f in old}
    for f in new:
        if f.name in have and have[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} is {have[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType([T.StructField(f.name, f.dataType) for f in [*old, *(f for f in new if f.name not in have)]])


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


def tier(size: int, fanout: int = FANOUT, least: int = LEAST_BYTES) -> int:
    """Sizes within a factor of fanout share a tier."""
    return max(0, int(math.log(max(size, 1) / least, fanout))) if size > least else 0


def plan_merges(shards: list[Shard], target: int, fanout: int) -> list[list[Shard]]:
    """Which shards to merge: a tier with fanout or more shards under the target size is cut into runs of about the target size."""
    tiers: dict[int, list[Shard]] = {}
    for s in sorted(shards, key=lambda s: (s.bytes, s.path)):
        if s.bytes < target * 3 // 4:
            tiers.setdefault(tier(s.bytes, fanout), []).append(s)
    out = []
    for _, members in sorted(tiers.items()):
        if len(members) < fanout:
            continue
        runs, size = [[]], 0
        for s in members:
            if runs[-1] and size + s.bytes > target * 5 // 4:
                runs.append([])
                size = 0
            runs[-1].append(s)
            size += s.bytes
        out += [r for r in runs if len(r) > 1]
    return out


class ShardStore:
    """A table of immutable Parquet shards under a folder that all executors share.

    A version is a manifest file: the schema and the shards that are live. A commit writes the manifest aside and renames it to
    its version's name, which fails when another writer has that name; so readers see whole versions only, and lost
    writers leave nothing but unlisted files, which vacuum removes. Shards never change.
    """

    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, runs_a_round: int = RUNS_A_ROUND) -> None:
        self.spark, self.root, self.target, self.fanout, self.runs_a_round = spark, root.rstrip("/"), target_bytes, fanout, runs_a_round
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, text: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest/{version:012d}.json"

    def version(self) -> int:
        """The newest version; 0 before any."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(self._manifest(version)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def commit(self, base: int, shards: list[Shard], schema: str) -> int:
        """Publish base + 1; Conflict if it is there already."""
        version = base + 1
        aside = f"{self.root}/manifest/_{uuid.uuid4().hex}.tmp"
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        out = self._fs.create(self._path(aside), False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 0)
        try:
            files.rename(self._path(aside), self._path(self._manifest(version)), options)
        except Py4JJavaError as e:
            self._fs.delete(self._path(aside), False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version}") from None
            raise
        return version

    def _listed(self, folder: str) -> list[Shard]:
        found, todo = [], [self._path(folder)]
        while todo:
            for s in self._fs.listStatus(todo.pop()):
                if s.isDirectory():
                    todo.append(s.getPath())
                elif s.getPath().getName().endswith(".parquet"):
                    found.append(Shard(s.getPath().toString(), s.getLen()))
        return sorted(found, key=lambda s: s.path)

    def _write(self, rows: DataFrame, *by: str) -> str:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(folder)
        return folder

    def append(self, rows: DataFrame, arrival: Any = None) -> int:
        """Write rows as small shards and list them, one version an arrival.

        arrival: a column that tells arrivals apart that come in one frame; each is committed on its own. Rows may bring
        new columns, which older rows have as null, and may lack columns; a column of another type is refused.
        """
        if now := self.manifest()["schema"]:
            merged_schema(T.StructType.fromJson(json.loads(now)), rows.schema)
        by = "_sh_arrival"
        while by in rows.columns:
            by += "_"
        folder = self._write(rows.withColumn(by, F.lit(0) if arrival is None else arrival), by)
        new: dict[str, list[Shard]] = {}
        for s in self._listed(folder):
            new.setdefault(s.path.split(f"{by}=")[1].split("/")[0], []).append(s)
        for _, shards in sorted(new.items()) or [("", [])]:
            self._retried(lambda m, add=shards: m + add, rows.schema)
        return self.version()

    def _retried(self, change: Any, schema: T.StructType) -> None:
        while True:
            now = self.manifest()
            both = merged_schema(T.StructType.fromJson(json.loads(now["schema"])), schema) if now["schema"] else schema
            try:
                self.commit(now["version"], change([Shard(**s) for s in now["shards"]]), both.json())
                return
            except Conflict:
                continue

    def read(self, version: int | None = None, *, shard: str | None = None) -> DataFrame:
        """The live rows of a version. shard: a column to add, with the file a row is in."""
        now = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(now["schema"])) if now["schema"] else T.StructType([])
        paths = [s["path"] for s in now["shards"]]
        if not paths:
            rows = self.spark.createDataFrame([], schema)
            return rows.withColumn(shard, F.lit(None).cast("string")) if shard else rows
        rows = self.spark.read.schema(schema).parquet(*paths)
        return rows.select("*", F.col("_metadata.file_path").alias(shard)) if shard else rows

    def compact(self) -> int:
        """Merge until no tier has fanout shards that could be merged; one job and one version a round.

        A run is read and written by one task, of about the target size, so rows are not shuffled. A round merges at most
        runs_a_round runs; the next one goes on from the manifest, so a lost driver loses one round.
        """
        while True:
            now = self.manifest()
            runs = plan_merges([Shard(**s) for s in now["shards"]], self.target, self.fanout)[: self.runs_a_round]
            if not runs:
                return now["version"]
            schema = T.StructType.fromJson(json.loads(now["schema"]))
            parts = [self.spark.read.schema(schema).parquet(*[s.path for s in r]).coalesce(1) for r in runs]
            folder = self._write(reduce(DataFrame.unionAll, parts))
            made, gone = self._listed(folder), {s.path for r in runs for s in r}

            def swapped(live: list[Shard], made=made, gone=gone) -> list[Shard]:
                if not gone <= {s.path for s in live}:
                    raise Replaced
                return [s for s in live if s.path not in gone] + made

            try:
                self._retried(swapped, schema)
            except Replaced:  # another compaction was first: what was made here is dropped, and the plan made anew
                self._fs.delete(self._path(folder), True)

    def vacuum(self, grace: float = GRACE) -> int:
        """Delete files that the newest version doesn't list and that are older than grace seconds; older versions can't be read after.

        A writer has to commit within the grace; with 0 there may be no other writer.
        """
        live, before = {s.path for s in self.shards()}, (time.time() - grace) * 1000
        old = [s for s in self._listed(f"{self.root}/data") if s.path not in live] if self._fs.exists(self._path(f"{self.root}/data")) else []
        old = [s for s in old if not grace or self._fs.getFileStatus(self._path(s.path)).getModificationTime() < before]
        for s in old:
            self._fs.delete(self._path(s.path), False)
        return len(old)


def new_root(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/shards-{uuid.uuid4().hex}"


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in 16 arrivals by id, appended, compacted and read back from the manifest.

    Null ids arrive with arrival 0; empty tables give no rows; texts, nulls and repeated rows come back as they were.
    Returns doc_id, n_bytes, text_sha256.
    """
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, new_root(spark))
    store.append(docs, F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"), F.lit(0)))
    store.compact()
    store.vacuum(0)
    return store.read().select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


#: DuckDB: what comes back is what went in.
SQL = "SELECT doc_id, strlen(text)::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents"
