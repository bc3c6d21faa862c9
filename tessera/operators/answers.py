"""The cache of model answers: immutable segments of sorted keys, and logs in which each answer lands as soon as it is there.

    segments/bucket=ab/part-*.parquet   keys that begin with ab, sorted, with the smallest and largest key and a Bloom filter of each row group
    logs/RUN/PARTITION/*.log            the answers of one task, a line each with its checksum, until the run is sealed into segments

A lookup reads the segments of the buckets that it asks for. A task that is run again finds its finished answers in the logs of its earlier attempts, and what a
run that died has left in logs is read like segments. A damaged entry is an error; the torn last line of a log is a call that did not finish.
The folder must be on a file system that all machines mount.
"""

from __future__ import annotations

import glob
import json
import os
import shutil
import threading
import time
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import CacheError

ENTRY = "key string, answer string, answered_at string, retries int"
BUCKET = 2  # characters of a key, which is a hexadecimal digest
#: Keys up to which a lookup names them, so that row groups without them are not opened.
NAMED = 64
#: Segments of a bucket beyond which they are merged, and seconds after which the logs of a silent run are sealed by another.
MOST_SEGMENTS, SILENT = 8, 3600


class AnswerLog:
    """One task's log. Lines are written whole, by one thread at a time, and synced as soon as the disk is free, all that were written meanwhile together."""

    def __init__(self, folder: str):
        self.folder = folder
        self.lock, self.file = threading.Lock(), None
        self.changed, self.syncer = threading.Condition(self.lock), None
        self.written, self.synced, self.closed, self.error = 0, 0, False, None

    def earlier(self) -> dict[str, dict[str, Any]]:
        """What earlier attempts at this partition have finished."""
        return {e["key"]: e for path in glob.glob(os.path.join(glob.escape(self.folder), "*.log")) for e in read_log(path)}

    def append(self, entry: dict[str, Any]) -> None:
        """An entry that is on disk when this returns."""
        self.write(entry)
        self.settle()

    def write(self, entry: dict[str, Any]) -> None:
        """An entry that is in the file when this returns, and will be on disk after settle()."""
        body = json.dumps(entry, ensure_ascii=False)
        line = f"{zlib.crc32(body.encode('utf-8', 'surrogatepass')):08x} {body}\n".encode("utf-8", "surrogatepass")
        try:
            with self.lock:
                if self.file is None:
                    os.makedirs(self.folder, exist_ok=True)
                    self.file = os.open(os.path.join(self.folder, f"{uuid.uuid4().hex}.log"), os.O_WRONLY | os.O_CREAT | os.O_APPEND)
                    self.syncer = threading.Thread(target=self._sync, daemon=True)
                    self.syncer.start()
                os.write(self.file, line)
                self.written += 1
                self.changed.notify_all()
        except OSError as e:
            raise self._failed(e) from e

    def _failed(self, e: OSError) -> CacheError:
        return CacheError(f"cannot write to the log of answers in {self.folder}: {e}")

    def _sync(self) -> None:
        while True:
            with self.changed:
                self.changed.wait_for(lambda: self.closed or self.written > self.synced)
                if self.written == self.synced:
                    return
                reached = self.written
            try:
                os.fsync(self.file)
            except OSError as e:
                with self.changed:
                    self.error = e
                    self.changed.notify_all()
                return
            with self.changed:
                self.synced = reached
                self.changed.notify_all()

    def settle(self) -> None:
        """Waits until all that is written by now is on disk."""
        with self.changed:
            reached = self.written
            self.changed.wait_for(lambda: self.error or self.synced >= reached)
            if self.synced < reached:
                raise self._failed(self.error) from self.error

    def close(self) -> None:
        if self.file is not None:
            with self.changed:
                self.closed = True
                self.changed.notify_all()
            self.syncer.join()
            os.close(self.file)
            self.file = None


def read_log(path: str) -> Iterator[dict[str, Any]]:
    """The entries of a log, without a torn last line."""
    try:
        with open(path, "rb") as f:
            for line in f:
                if not line.endswith(b"\n"):
                    return
                check, _, body = line[:-1].partition(b" ")
                if check != f"{zlib.crc32(body):08x}".encode():
                    raise CacheError(f"a cache entry in {path} is damaged")
                yield json.loads(body)
    except FileNotFoundError:  # sealed meanwhile
        return
    except OSError as e:
        raise CacheError(f"cannot read the cache entries in {path}: {e}") from e


class AnswerStore:
    def __init__(self, directory: str):
        self.directory = os.path.abspath(directory)
        self.segments, self.logs = os.path.join(self.directory, "segments"), os.path.join(self.directory, "logs")

    def log(self, run: str) -> AnswerLog:
        """The log of the task that calls this."""
        return AnswerLog(os.path.join(self.logs, run, str(TaskContext.get().partitionId())))

    def bucket(self, name: str) -> str:
        return os.path.join(self.segments, f"bucket={name}")

    def _left(self, run: str) -> list[str]:
        return glob.glob(os.path.join(glob.escape(self.logs), run, "*", "*.log"))

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """ENTRY of those of keys (key) that are there, each once; None if there can be none."""
        spark, frames = keys.sparkSession, []
        asked = [r[0] for r in keys.select(F.substring("key", 1, BUCKET)).distinct().collect()]  # 256 at most
        paths = [self.bucket(name) for name in asked if os.path.isdir(self.bucket(name))]
        few = [r[0] for r in keys.limit(NAMED + 1).select("key").collect()]
        if paths:
            held = _read(spark, paths)
            frames.append(held.where(F.col("key").isin(few)) if len(few) <= NAMED else held)
        if left := self._left("*"):
            frames.append(_logged(spark, left))
        if not frames:
            return None
        found = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
        sound = F.when(F.expr("try_parse_json(answer) IS NOT NULL AND answered_at IS NOT NULL"), F.col("answer")).otherwise(F.raise_error(F.concat(F.lit("the cache entry of "), "key", F.lit(" is damaged"))))
        return found.join(keys.select("key"), "key", "left_semi").dropDuplicates(["key"]).withColumn("answer", sound)

    def add(self, entries: DataFrame) -> None:
        """ENTRY as new segments. Buckets with many segments are merged; who reads them meanwhile may miss answers, which are asked for again, but does not fail."""
        touched = [r[0] for r in entries.select(F.substring("key", 1, BUCKET)).distinct().collect()]
        self._write(entries)
        crowded = [own for name in touched if len(own := glob.glob(os.path.join(glob.escape(self.bucket(name)), "*.parquet"))) > MOST_SEGMENTS]
        if crowded:
            old = [path for own in crowded for path in own]
            self._write(_read(entries.sparkSession, old).dropDuplicates(["key"]))
            for path in old:
                os.remove(path)

    def _write(self, entries: DataFrame) -> None:
        tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as small tables too make a file for each bucket, which takes its time
        dealt = entries.selectExpr("key", "answer", "answered_at", "retries", f"substring(key, 1, {BUCKET}) AS bucket").repartition(tasks, "bucket").sortWithinPartitions("bucket", "key")
        dealt.write.mode("append").partitionBy("bucket").option("compression", "zstd").option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(f"file://{self.segments}")

    def seal(self, spark: SparkSession, run: str) -> None:
        """Moves what is in the logs of a run to segments."""
        if left := self._left(run):
            self.add(_logged(spark, left).dropDuplicates(["key"]))
        self.forget(run)

    def forget(self, run: str) -> None:
        """Removes the logs of a run whose answers are in segments."""
        shutil.rmtree(os.path.join(self.logs, run), ignore_errors=True)

    def recover(self, spark: SparkSession) -> None:
        """Seals the logs of runs that have long been silent."""
        for run in os.listdir(self.logs) if os.path.isdir(self.logs) else ():
            times = [os.path.getmtime(p) for p in self._left(run)]
            if times and time.time() - max(times) > SILENT:
                self.seal(spark, run)


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(ENTRY).option("ignoreMissingFiles", "true").parquet(*[f"file://{p}" for p in paths])


def _logged(spark: SparkSession, paths: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield pd.DataFrame(list(read_log(path)), columns=["key", "answer", "answered_at", "retries"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 64)).mapInPandas(run, ENTRY)
