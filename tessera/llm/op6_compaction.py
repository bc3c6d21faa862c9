"""Operator 6: a table of immutable shards with size-tiered compaction and a versioned manifest.

Arrivals are appended as small shards. A shard's tier is the logarithm of its size; where a tier holds fanout shards or more below the target size,
similarly sized neighbours are merged into files of about the target size: all merges of a round are one Spark job, in which each group of
shards has a partition of its own, so no task ever holds more than a target-sized file. Readers see only what a manifest names. A manifest is
written beside its place and then renamed to its version number, which fails if another writer took that number first; the writer then tries again on
top of what the other one wrote. Merged shards of older versions stay until vacuum(), which spares files that may belong to a
writer at work. Only DataFrame operations and Hadoop's file system calls are used.

Rows pass through whole whatever they hold: nulls, empty and very long texts, repeats, and any columns, as our own are named anew each time; an empty
arrival adds no shard. A row of a merged shard that no group claims is an error, not a loss.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table


#: Shards of a round, about 100 bytes each, up to which their groups are broadcast; beyond it they are joined by a shuffle.
BROADCAST_SHARDS = 50_000


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Shard:
    path: str  # below the root
    bytes: int


def _own_name(kind: str) -> str:
    """A column name that no table has."""
    return f"{kind}_{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Manifest:
    version: int
    operation: str
    shards: tuple[Shard, ...]


class ShardedTable:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, small_bytes: int = 1 << 20, fanout: int = 4):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.small_bytes, self.fanout = target_bytes, small_bytes, fanout
        self._hadoop = spark._jvm.org.apache.hadoop
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self._hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    # manifests

    def versions(self) -> list[int]:
        if not self._files.exists(self._path("_manifest")):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path("_manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if not version:
            return Manifest(0, "create", ())
        stream = self._files.open(self._path(f"_manifest/v{version:010d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        raw = json.loads(text)
        return Manifest(raw["version"], raw["operation"], tuple(Shard(**s) for s in raw["shards"]))

    def _commit(self, based_on: Manifest, operation: str, shards: tuple[Shard, ...]) -> Manifest:
        made = Manifest(based_on.version + 1, operation, shards)
        self._files.mkdirs(self._path("_manifest"))
        beside = self._path(f"_manifest/.{uuid.uuid4().hex}.tmp")
        stream = self._files.create(beside, False)
        try:
            stream.write(bytearray(json.dumps(asdict(made)).encode()))
        finally:
            stream.close()
        context = self._hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        no_overwrite[0] = getattr(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        try:
            context.rename(beside, self._path(f"_manifest/v{made.version:010d}.json"), no_overwrite)
        except Exception as e:
            self._files.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {made.version} exists") from e
            raise
        return made

    def _commit_anew(self, operation: str, change: Callable[[tuple[Shard, ...]], tuple[Shard, ...]], attempts: int = 20) -> Manifest:
        """Commits a change of the newest version's shards, again from the newest version where another writer was first."""
        for attempt in range(attempts):
            now = self.manifest()
            try:
                return self._commit(now, operation, change(now.shards))
            except CommitConflict:
                if attempt + 1 == attempts:
                    raise
        raise AssertionError

    # shards

    def _listed(self, below: str) -> list[Shard]:
        found, files = [], self._files.listFiles(self._path(below), True)
        prefix = self._files.makeQualified(self._path("")).toString() + "/"
        while files.hasNext():
            status = files.next()
            if status.getPath().getName().endswith(".parquet"):
                found.append(Shard(status.getPath().toString().removeprefix(prefix), status.getLen()))
        return sorted(found, key=lambda s: s.path)

    def append(self, rows: DataFrame) -> Manifest:
        return self.append_arrivals(rows, F.lit(0))

    def append_arrivals(self, rows: DataFrame, arrival: Column) -> Manifest:
        """Appends what rows hold for each value of an expression, one after another, each as a version; the data are written in one job. All columns of rows
        are kept."""
        below, name = f"data/{uuid.uuid4().hex}", _own_name("arrival")
        named = rows.withColumn(name, F.coalesce(F.hex(arrival.cast("string")), F.lit("none")))
        named.write.partitionBy(name).option("compression", "zstd").parquet(f"{self.root}/{below}")
        by: dict[str, list[Shard]] = {}
        for shard in self._listed(below):
            by.setdefault(shard.path.rsplit("/", 2)[1], []).append(shard)
        now = self.manifest()
        for name in sorted(by):
            now = self._commit_anew(f"append {name}", lambda shards, new=tuple(by[name]): shards + new)
        return now

    def read(self, version: int | None = None) -> DataFrame:
        shards = self.manifest(version).shards
        if not shards:
            raise ValueError("the table has no shards")
        return self.spark.read.parquet(*(f"{self.root}/{s.path}" for s in shards))

    # compaction

    def tier(self, size: int) -> int:
        return max(0, math.ceil(math.log(max(size, 1) / self.small_bytes, self.fanout)))

    def plan(self, shards: tuple[Shard, ...]) -> list[list[Shard]]:
        """Groups to merge: runs of similarly sized shards of one tier that make a file of about the target size at most."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes <= self.target_bytes // 2:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        groups: list[list[Shard]] = []
        for level in sorted(tiers):
            run = sorted(tiers[level], key=lambda s: (s.bytes, s.path))
            if len(run) < self.fanout:
                continue
            group: list[Shard] = []
            for s in run:
                if group and sum(x.bytes for x in group) + s.bytes > self.target_bytes:
                    groups.append(group)
                    group = []
                group.append(s)
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact_once(self) -> Manifest | None:
        """One round of merges and its commit; None if no tier is full."""
        now = self.manifest()
        groups = self.plan(now.shards)
        if not groups:
            return None
        tail = lambda path: "/".join(path.rsplit("/", 3)[1:])
        listed = [(tail(s.path), k) for k, g in enumerate(groups) for s in g]
        file, group = _own_name("file"), _own_name("group")
        names = self.spark.createDataFrame(listed, f"{file} string, {group} int")
        names = F.broadcast(names) if len(listed) <= BROADCAST_SHARDS else names
        merged = self.spark.read.parquet(*(f"{self.root}/{s.path}" for g in groups for s in g)).withColumn(file, F.regexp_extract(F.input_file_name(), r"([^/]+/[^/]+/[^/]+)$", 1))
        below = f"data/{uuid.uuid4().hex}"
        dealt = merged.join(names, file, "left").withColumn(group, F.coalesce(group, F.raise_error(F.concat(F.lit("no group has the shard "), file)).cast("int"))).drop(file)
        dealt.repartitionById(len(groups), F.col(group)).write.partitionBy(group).option("compression", "zstd").parquet(f"{self.root}/{below}")
        gone, made = {s.path for g in groups for s in g}, tuple(self._listed(below))

        def replaced(shards: tuple[Shard, ...]) -> tuple[Shard, ...]:
            if not gone <= {s.path for s in shards}:
                raise RuntimeError("another writer merged the same shards")
            return tuple(s for s in shards if s.path not in gone) + made

        return self._commit_anew(f"merge {len(gone)} shards", replaced)

    def compact(self) -> Manifest:
        """Rounds until no tier is full; each round has fewer shards than the one before."""
        while True:
            before = len(self.manifest().shards)
            made = self.compact_once()
            if made is None or len(made.shards) >= before:
                return self.manifest()

    def vacuum(self, older_than: float = 86_400) -> int:
        """Deletes shards that the newest manifest does not name, and older manifests. Files that were written in the last older_than seconds stay, as a
        writer may be about to commit them; 0 is for a table without other writers."""
        now = self.manifest()
        live, gone, before = {s.path for s in now.shards}, 0, 1000 * (time.time() - older_than)
        for s in self._listed("data"):
            if s.path not in live and self._files.getFileStatus(self._path(s.path)).getModificationTime() <= before:
                self._files.delete(self._path(s.path), False)
                gone += 1
        for v in self.versions():
            if v < now.version:
                self._files.delete(self._path(f"_manifest/v{v:010d}.json"), False)
        return gone


def op6_compaction(spark: SparkSession, sf_dir: str, arrivals: int = 4, target_bytes: int = 32 << 20) -> DataFrame:
    """Every document as read from the compacted table: doc_id, n_bytes, text_sha256."""
    store = ShardedTable(spark, Scratch(spark, "shards").path(), target_bytes)
    documents = table(spark, sf_dir, "documents")
    store.append_arrivals(documents, F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(arrivals)))
    store.compact()
    store.vacuum(0)
    return store.read().select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


ORACLE_SQL = "SELECT doc_id, strlen(text)::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents"
