"""Sharded storage with size-tiered compaction and a versioned manifest.

Arrivals are appended as small immutable shards (Parquet files). Shards of similar size form tiers; when a
tier has ``fan_in`` shards, they are merged into files of about ``target_bytes``, which are final. A manifest
lists the shards of each version; the next version is written beside it and renamed into place, which fails if
another writer was first, so readers see either version whole. Shards that no manifest of the retained
versions names are deleted by ``vacuum``.

Merging is a Spark read of a tier's files, packed into input partitions of the target size and of ``MOST_FILES``
files at most, and a write of one file for each: no shuffle, and a source with a third of all rows is spread like
any other. Files of a write stay in the folder that they were written to. Only their names, sizes and counts of
rows pass the driver.

The manifest holds the columns and types of all shards, and all reads, merges included, go by them. An arrival may
have more columns or fewer, and wider or narrower numbers: the store's columns are those of all arrivals, in order
of arrival, null where a shard lacks them, and its numbers the wider ones. Other differences of type, names that
differ in case alone, and a column ``shard`` are refused before anything is written (``ValueError``).

Rows are stored as they are: nulls, empty and very long texts and repeated rows. Files without rows
are no shards, so appending an empty table only commits a version. Shards of equal size are merged in the order
of their names.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types that a Parquet reader takes for any before it: whole numbers, and numbers that a double holds exactly.
WIDER = ((T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()), (T.ByteType(), T.ShortType(), T.IntegerType(), T.DoubleType()), (T.FloatType(), T.DoubleType()))
#: Files that one task of a merge reads, as each leaves buffers behind.
MOST_FILES = 64


@dataclass(frozen=True)
class Shard:
    name: str  # folder of its write, which begins with the version that was to be, and file
    size: int
    tier: int  # -1: of the target size, never merged again
    version: int  # that added it
    rows: int


@dataclass(frozen=True)
class Manifest:
    version: int
    shards: tuple[Shard, ...]
    schema: T.StructType | None = None  # None before the first arrival


class Conflict(Exception):
    """Another writer committed the version first."""


def merged(have: T.StructType | None, new: T.StructType) -> T.StructType:
    """The columns of both, in order, with the wider of two numeric types; ``ValueError`` if they don't fit."""
    out = {f.name: f.dataType for f in have or ()}
    taken = {c.lower(): c for c in out}
    if "shard" in (c.lower() for c in new.names):
        raise ValueError("'shard' is a column of what the store returns")
    for f in new:
        known = taken.setdefault(f.name.lower(), f.name)
        if known != f.name:
            raise ValueError(f"columns {known!r} and {f.name!r} differ in case alone")
        a, b = out.get(f.name, f.dataType), f.dataType
        wider = next((w for ladder in WIDER for w in (a, b) if {a, b} <= set(ladder) and ladder.index(w) == max(map(ladder.index, (a, b)))), None)
        if a != b and wider is None:
            raise ValueError(f"column {f.name!r} is {a.simpleString()} in the store and {b.simpleString()} in the arrival")
        out[f.name] = a if a == b else wider
    return T.StructType([T.StructField(c, t) for c, t in out.items()])


class Store:
    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = 256 << 20, base_bytes: int = 1 << 20, fan_in: int = 4):
        self.spark, self.root, self.target, self.base, self.fan_in = spark, root.rstrip("/"), target_bytes, base_bytes, fan_in
        self._fs, self._path = None, spark._jvm.org.apache.hadoop.fs.Path

    def _files(self):
        if self._fs is None:
            self._fs = self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self._fs

    def _list(self, folder: str) -> list[tuple[str, int]]:
        path = self._path(f"{self.root}/{folder}")
        return sorted((s.getPath().getName(), s.getLen()) for s in self._files().listStatus(path)) if self._files().exists(path) else []

    def tier(self, size: int) -> int:
        """Shards of one tier differ in size by less than ``fan_in`` times; -1 from half the target on."""
        return -1 if size >= self.target / 2 else max(0, math.floor(math.log(max(1, size / self.base), self.fan_in)))

    def current(self) -> Manifest:
        """The latest committed manifest; version 0 without shards if there is none."""
        names = [n for n, _ in self._list("manifests") if n.endswith(".json")]
        return self.manifest(int(max(names).removesuffix(".json"))) if names else Manifest(0, ())

    def manifest(self, version: int) -> Manifest:
        """A version that is retained."""
        stream = self._files().open(self._path(f"{self.root}/manifests/{version:012d}.json"))
        try:
            raw = json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
        return Manifest(raw["version"], tuple(Shard(**s) for s in raw["shards"]), T.StructType.fromJson(raw["schema"]) if raw.get("schema") else None)

    def commit(self, shards: list[Shard], after: Manifest, schema: T.StructType | None = None) -> Manifest:
        """Write the version after ``after``, with its schema or another; ``Conflict`` if it is there already."""
        new = Manifest(after.version + 1, tuple(sorted(shards, key=lambda s: s.name)), schema or after.schema)
        target = self._path(f"{self.root}/manifests/{new.version:012d}.json")
        own = self._path(f"{self.root}/manifests/.{new.version:012d}-{uuid.uuid4().hex}")
        out = self._files().create(own, False)
        out.write(bytearray(json.dumps({"version": new.version, "schema": new.schema and new.schema.jsonValue(), "shards": [asdict(s) for s in new.shards]}).encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            # a rename without options fails where the target exists; it is one step in HDFS
            context.rename(own, target, gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._files().delete(own, False)
            if "FileAlreadyExists" in e.java_exception.toString():
                raise Conflict(f"version {new.version} exists") from None
            raise
        return new

    def _write(self, df: DataFrame, version: int) -> list[Shard]:
        """Write ``df`` into a folder of its own; its files that have rows are the shards."""
        folder = f"v{version:012d}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.root}/shards/{folder}")
        sizes = {n: size for n, size in self._list(f"shards/{folder}") if n.endswith(".parquet")}
        counted = self.spark.read.schema(df.schema).parquet(f"{self.root}/shards/{folder}").groupBy(F.col("_metadata.file_name").alias("name")).count().collect()
        return [Shard(f"{folder}/{r['name']}", sizes[r["name"]], self.tier(sizes[r["name"]]), version, r["count"]) for r in sorted(counted, key=lambda r: r["name"])]

    def append(self, df: DataFrame) -> Manifest:
        """Add an arrival as new shards, one for each of its partitions that has rows; ``Conflict`` if another writer was first."""
        after = self.current()
        schema = merged(after.schema, df.schema)
        return self.commit([*after.shards, *self._write(df, after.version + 1)], after, schema)

    def plan(self, shards: tuple[Shard, ...]) -> list[list[Shard]]:
        """The shards of each tier that has enough of them, by size."""
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(shards, key=lambda s: (s.size, s.name)):
            if s.tier >= 0:
                tiers.setdefault(s.tier, []).append(s)
        return [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan_in]

    def compact(self) -> Manifest:
        """Merge until no tier has enough shards; each merge is a version of its own."""
        now = self.current()
        while groups := self.plan(now.shards):
            merged, gone = [], set()
            for group in groups:
                merged += self._write(self._packed(group, now.schema), now.version + 1)
                gone |= {s.name for s in group}
            after = self.commit([*(s for s in now.shards if s.name not in gone), *merged], now)
            if len(after.shards) >= len(now.shards):
                return after
            now = after
        return now

    def _packed(self, group: list[Shard], schema: T.StructType) -> DataFrame:
        """The rows of ``group`` in partitions of about the target size, by a session that packs small files."""
        total = sum(s.size for s in group)
        wanted = max(1, round(total / self.target), math.ceil(len(group) / MOST_FILES))
        session = self.spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        session.conf.set("spark.sql.files.openCostInBytes", str(self.target // MOST_FILES))
        session.conf.set("spark.sql.files.minPartitionNum", str(wanted))
        df = session.read.schema(schema).parquet(*[f"{self.root}/shards/{s.name}" for s in group])
        return df.coalesce(wanted) if df.rdd.getNumPartitions() > wanted else df

    def stored(self) -> list[str]:
        """The names of all shards that are in the store, named by a manifest or not."""
        return [f"{folder}/{n}" for folder, _ in self._list("shards") for n, _ in self._list(f"shards/{folder}") if n.endswith(".parquet")]

    def vacuum(self, keep_versions: int = 1) -> None:
        """Delete manifests before the last ``keep_versions``, and the shards that none of the others names.

        Shards of a version that is still to come are spared: an append that is under way will name them. One of
        a version that is there already can't be committed any more.
        """
        if isinstance(keep_versions, bool) or not isinstance(keep_versions, int) or keep_versions < 1:
            raise ValueError("keep_versions must be 1 at least")
        names = [n for n, _ in self._list("manifests") if n.endswith(".json")]
        kept = [self.manifest(int(n.removesuffix(".json"))) for n in names[-keep_versions:]]
        used, now = {s.name for m in kept for s in m.shards}, max((m.version for m in kept), default=0)
        for n in names[:-keep_versions]:
            self._files().delete(self._path(f"{self.root}/manifests/{n}"), False)
        for folder, _ in self._list("shards"):
            if int(folder[1:13]) > now:
                continue
            own = [n for n, _ in self._list(f"shards/{folder}")]
            gone = [n for n in own if f"{folder}/{n}" not in used]
            for n in [""] if len(gone) == len(own) else gone:
                self._files().delete(self._path(f"{self.root}/shards/{folder}/{n}".rstrip("/")), True)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the current or another retained version, with the shard of each in ``shard``."""
        now = self.current() if version is None else self.manifest(version)
        if not now.shards:
            raise ValueError("the store has no rows")
        df = self.spark.read.schema(now.schema).parquet(*[f"{self.root}/shards/{s.name}" for s in now.shards])
        return df.withColumn("shard", F.array_join(F.slice(F.split(F.col("_metadata.file_path"), "/"), -2, 2), "/"))
