"""Sharding by size-tiered compaction, in DataFrame operations and the session's file system only.

A dataset is a folder of immutable Parquet shards and numbered manifests. append() writes an arrival as small
shards and commits a manifest that adds them. compact() groups shards of one size tier (sizes within a factor of
FAN of each other), merges tiers that hold at least FAN shards, or enough bytes, into files of about the target
size, and commits a manifest that replaces them. A manifest holds the schema of the whole dataset and each shard's
path, size and version; readers see one whole version or the other, and every version stays readable until vacuum().

A commit puts a finished file under the next version's name, and only if that name is free: by a hard link on a
local file system, elsewhere by a rename that never overwrites, which HDFS does atomically. (Stores without an
atomic rename need one writer at a time.) A writer that loses the name reads the new version and tries again:
appends add to it; a merge is given up where another writer merged one of its shards.

vacuum() deletes data files that no manifest kept names and that are older than `age` seconds by the file system's
own clock, so files that an open writer has written and not yet committed stay; `age` must exceed the longest write.
A commit whose files are gone all the same fails and names them.

Merging reads whole files one after another in each task, without a shuffle, at most RUN shards a job. Which rows a
shard holds follows the order of arrival, so a hot source or key never gathers in one task. The manifest is read
and written by the driver: about 100 bytes a shard, 10 MB at 100 TB in shards of 1 GB (`target_bytes`).

Defined results: all rows with all columns are kept, nulls, repeated rows, empty and very long texts included; an
empty arrival commits a version without new shards; a version that does not exist raises an error. Columns match by
name, letters in either case equal: an arrival may lack columns (null there) or bring new ones (null before), and
one that gives a column another type raises an error before it is committed. read() numbers the shards in a column
`shard`, or shard_2, shard_3 and so on where the data have such a column themselves. Shards of equal size are taken
in the order of their paths.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import hadoop_fs, new_path

TARGET_BYTES = 128 << 20
#: Shards of one tier that are merged at least; also the factor between tiers.
FAN = 4
#: Shards that one merging job reads at most; a longer tier is merged by several jobs.
RUN = 4096
#: Seconds for which vacuum() leaves files alone that no manifest names.
AGE = 24 * 3600.0
#: Times that a commit is tried while other writers take its version.
TRIES = 60


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    version: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    shards: list[Shard] = field(default_factory=list)
    schema: str | None = None


class _Conflict(Exception):
    pass


def _nullable(x):
    """A data type's JSON form without what it says of nulls."""
    if isinstance(x, dict):
        return {k: True if k in ("nullable", "containsNull", "valueContainsNull") else _nullable(v) for k, v in x.items() if k != "metadata"}
    return [_nullable(y) for y in x] if isinstance(x, list) else x


def merged_schema(old: str | None, new: T.StructType) -> str:
    """The columns of both by name, the old ones first; ValueError where one has two types."""
    fields = {f.name.lower(): f for f in (T.StructType.fromJson(json.loads(old)).fields if old else [])}
    for f in new.fields:
        own = fields.setdefault(f.name.lower(), f)
        if _nullable(own.dataType.jsonValue()) != _nullable(f.dataType.jsonValue()):
            raise ValueError(f"column {f.name} is {own.dataType.simpleString()} in the dataset and {f.dataType.simpleString()} in the arrival")
    return json.dumps(_nullable(T.StructType([T.StructField(f.name, f.dataType, True) for f in fields.values()]).jsonValue()) | {"type": "struct"})


class ShardSet:
    def __init__(self, spark: SparkSession, folder: str | None = None, target_bytes: int = TARGET_BYTES, fan: int = FAN):
        self.spark, self.folder, self.target, self.fan = spark, folder or new_path(spark, "shards"), target_bytes, fan
        self.fs, _ = hadoop_fs(spark, self.folder)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        p = self._path("manifests")
        if not self.fs.exists(p):
            return 0
        names = [str(s.getPath().getName()) for s in self.fs.listStatus(p)]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        v = self.version() if version is None else version
        if not v:
            return Manifest()
        if not self.fs.exists(self._path(f"manifests/v{v:08d}.json")):
            raise FileNotFoundError(f"{self.folder} has no version {v}")
        f = self.fs.open(self._path(f"manifests/v{v:08d}.json"))
        try:
            m = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8"))
        finally:
            f.close()
        return Manifest(m["version"], [Shard(**s) for s in m["shards"]], m["schema"])

    def shards(self, version: int | None = None) -> list[Shard]:
        return self.manifest(version).shards

    def _put(self, m: Manifest) -> bool:
        """Write a manifest under its version's name, unless that is taken."""
        self.fs.mkdirs(self._path("manifests"))
        half, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{m.version:08d}.json")
        out = self.fs.create(half, False)
        out.write(bytearray(json.dumps({"version": m.version, "schema": m.schema, "shards": [asdict(s) for s in m.shards]}).encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if str(self.fs.getUri().getScheme()) == "file":
                at = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark._sc._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(at(final), at(half))
            else:
                none = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(half, final, none)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(getattr(e, "java_exception", e)):
                return False
            raise
        finally:
            self.fs.delete(half, False)

    def _commit(self, change: Callable[[Manifest], tuple[list[Shard], str | None]]) -> int:
        """Commit what `change` makes of the latest version; again from the new latest one where another writer was faster."""
        for n in range(TRIES):
            now = self.manifest()
            shards, schema = change(now)
            known = {s.path for s in now.shards}
            lost = [s.path for s in shards if s.path not in known and not self.fs.exists(self._path(s.path))]
            if lost:
                raise FileNotFoundError(f"written shards are gone: {', '.join(lost[:5])}")
            if self._put(Manifest(now.version + 1, shards, schema)):
                return now.version + 1
            time.sleep(random.uniform(0, min(0.05 * 2**n, 2)))
        raise RuntimeError(f"no version could be committed in {TRIES} tries")

    def _listed(self, name: str, version: int) -> list[Shard]:
        p = self._path(name)
        if not self.fs.exists(p):
            return []
        found = sorted((str(s.getPath().getName()), int(s.getLen())) for s in self.fs.listStatus(p))
        return [Shard(f"{name}/{n}", size, version) for n, size in found if n.endswith(".parquet")]

    def _added(self, name: str, schema: T.StructType) -> int:
        return self._commit(lambda now: (now.shards + self._listed(name, now.version + 1), merged_schema(now.schema, schema)))

    def append(self, rows: DataFrame) -> int:
        """Write an arrival as it is partitioned, one small shard a task, and commit it."""
        name = f"data/{uuid.uuid4().hex[:16]}"
        merged_schema(self.manifest().schema, rows.schema)
        rows.write.parquet(f"{self.folder}/{name}")
        return self._added(name, rows.schema)

    def append_arrivals(self, rows: DataFrame, arrival: str) -> int:
        """Write rows of several arrivals in one pass and commit each arrival, without that column, as a version of its own."""
        name, schema = f"data/{uuid.uuid4().hex[:16]}", rows.drop(arrival).schema
        merged_schema(self.manifest().schema, schema)
        rows.write.partitionBy(arrival).parquet(f"{self.folder}/{name}")
        v = self.version()
        for d in sorted(str(s.getPath().getName()) for s in self.fs.listStatus(self._path(name)) if s.isDirectory()):
            v = self._added(f"{name}/{d}", schema)
        return v

    def _tiers(self, shards: list[Shard]) -> list[list[Shard]]:
        """Groups worth merging: shards of similar size that are many, or together fill a target."""
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(shards, key=lambda s: s.path):
            if s.bytes * 2 <= self.target:
                n, size = 0, max(s.bytes, 1)
                while size >= self.fan:
                    n, size = n + 1, size // self.fan
                tiers.setdefault(n, []).append(s)
        good = [t for _, t in sorted(tiers.items()) if len(t) >= self.fan or len(t) > 1 and sum(s.bytes for s in t) >= self.target]
        return [t[len(t) * i // n : len(t) * (i + 1) // n] for t in good for n in [-(-len(t) // RUN)] for i in range(n)]

    def compact(self) -> int:
        """Merge until no tier has enough shards, each group of shards as a version of its own. Returns the latest version."""
        while tiers := self._tiers(self.shards()):
            for tier in tiers:
                self._merge(tier)
        return self.version()

    def _merge(self, tier: list[Shard]) -> None:
        name, gone = f"data/{uuid.uuid4().hex[:16]}", {s.path for s in tier}

        def change(now: Manifest):
            if not gone <= {s.path for s in now.shards}:
                raise _Conflict
            return [s for s in now.shards if s.path not in gone] + self._listed(name, now.version + 1), now.schema

        part = self._read(tier, self.manifest().schema).coalesce(max(1, round(sum(s.bytes for s in tier) / self.target)))
        part.write.parquet(f"{self.folder}/{name}")
        try:
            self._commit(change)
        except _Conflict:
            self.fs.delete(self._path(name), True)

    def _read(self, shards: list[Shard], schema: str) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*(f"{self.folder}/{s.path}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with the number of their shard in the manifest as a further column."""
        m = self.manifest(version)
        if not m.version:
            raise FileNotFoundError(f"{self.folder} has no version yet")
        names = [f.name for f in T.StructType.fromJson(json.loads(m.schema)).fields]
        out = "shard"
        while out in {n.lower() for n in names}:
            out = f"shard_{int(out[6:] or 1) + 1}"
        if not m.shards:
            return self.spark.createDataFrame([], T.StructType.fromJson(json.loads(m.schema)).add(out, T.IntegerType()))
        # One task of append_arrivals() gives its files in all arrival folders one base name: only the path below the dataset tells shards apart.
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        number = self.spark.createDataFrame([(str(path(s.path).toUri()), i) for i, s in enumerate(m.shards)], "file string, number int")
        file = F.regexp_extract(F.input_file_name(), r".*/(data/[0-9a-f]{16}/.+)$", 1)
        rows = self._read(m.shards, m.schema).select(F.struct("*").alias("row"), file.alias("file"))
        rows = rows.join(F.broadcast(number) if len(m.shards) <= 100_000 else number, "file")
        return rows.select(*(F.col("row").getField(n).alias(n) for n in names), F.col("number").alias(out))

    def _clock(self) -> int:
        """Milliseconds by the file system that holds the dataset."""
        p = self._path(f"manifests/.{uuid.uuid4().hex}")
        self.fs.create(p, False).close()
        try:
            return int(self.fs.getFileStatus(p).getModificationTime())
        finally:
            self.fs.delete(p, False)

    def vacuum(self, keep: int = 1, age: float = AGE) -> int:
        """Delete data files older than `age` seconds that none of the last `keep` versions name; returns how many."""
        if not self.fs.exists(self._path("data")) or not self.version():
            return 0
        before, v = self._clock() - age * 1000, self.version()
        named = {s.path for i in range(max(1, v - keep + 1), v + 1) for s in self.shards(i)}
        gone, files = 0, self.fs.listFiles(self._path("data"), True)
        root = str(self.fs.makeQualified(self._path("data")).toUri().getPath())
        found = []
        while files.hasNext():
            s = files.next()
            found.append((s.getPath(), "data" + str(s.getPath().toUri().getPath())[len(root) :], int(s.getModificationTime())))
        named |= {s.path for s in self.shards()}
        for p, rel, at in found:
            if rel.endswith(".parquet") and rel not in named and at <= before:
                gone += bool(self.fs.delete(p, False))
        return gone
