"""Tables in the shared folder for results that must not be computed twice, and the single files that the dataflows write in order."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession

from tessera.errors import ExportError

#: A file by which a folder of parts is known as ours; readers of folders leave out names that begin with _.
OURS = "_tessera"


class Written:
    """Tables that live until close(), or until the driver ends: a model must not be asked again because a second action reads its answers."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ExportError("spark.checkpoint.dir must name a folder that all machines share")
        self.root = f"{root.rstrip('/') if root else 'file://' + tempfile.gettempdir()}/tessera-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._at_exit)

    def __call__(self, frame: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        frame.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def folder(self, name: str) -> str:
        """A folder beside the tables for files that tasks open themselves, which takes a file system that all machines mount."""
        scheme, _, path = self.root.rpartition(":")
        if scheme not in ("", "file"):
            raise ExportError(f"files cannot be opened below {self.root}; spark.checkpoint.dir must be a mounted folder for this")
        return os.path.join("/" + path.lstrip("/"), name)

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        atexit.unregister(self._at_exit)

    def _at_exit(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone already
            self.close()


def create_parent(path: str) -> None:
    try:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    except OSError as e:
        raise ExportError(f"cannot create the folder of {path}: {e}") from e


def write_lines(lines: DataFrame, by: list[Column], path: str, parts: bool = False) -> None:
    """Writes the column value, a line per row in the order of the columns by: one file, or with parts a folder of them."""
    dealt = lines.repartitionByRange(*by).sortWithinPartitions(*by).select("value")
    (write_folder if parts else write_file)(dealt, path)


def write_file(dealt: DataFrame, path: str) -> None:
    """Writes the column value of the partitions, one after another, as the lines of one file, on a file system that all machines mount.

    Each task writes a piece; from the sizes of the pieces, a row each, follows where each begins, and tasks copy them there, into a file of the whole
    size that takes its name when it is whole. A task that runs again writes the same bytes to the same place.
    """
    pieces = f"{os.path.abspath(path)}.{uuid.uuid4().hex}"
    whole = f"{pieces}.whole"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        own = os.path.join(pieces, f"{number}.{uuid.uuid4().hex}")
        with open(own, "wb") as f:
            for batch in batches:
                for value in batch.column("value"):
                    f.write(value.as_buffer())
                    f.write(b"\n")
            size = f.tell()
        os.replace(own, os.path.join(pieces, str(number)))
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([size], pa.int64())], ["piece", "size"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, begin in zip(batch.column("piece").to_pylist(), batch.column("begin").to_pylist()):
                with open(os.path.join(pieces, str(number)), "rb") as piece, open(whole, "r+b") as f:
                    f.seek(begin)
                    shutil.copyfileobj(piece, f, 1 << 20)
            yield batch.select(["piece"])

    try:
        os.makedirs(pieces)
        sizes = {r["piece"]: r["size"] for r in dealt.mapInArrow(write, "piece int, size long").collect()}
        begins = list(itertools.accumulate((sizes[n] for n in sorted(sizes)), initial=0))
        with open(whole, "wb") as f:
            f.truncate(begins[-1])
        rows = [(n, at) for n, at in zip(sorted(sizes), begins) if sizes[n]]
        if rows:
            spark = dealt.sparkSession
            spark.createDataFrame(rows, "piece int, begin long").repartition(len(rows)).mapInArrow(place, "piece int").count()
        os.replace(whole, path)
    except OSError as e:
        raise ExportError(f"cannot write {path}: {e}") from e
    finally:
        shutil.rmtree(pieces, ignore_errors=True)
        if os.path.exists(whole):
            os.remove(whole)


def check_folder(path: str) -> None:
    """Raises if a folder of part files may not be written at path: something that is no earlier output of ours lies there."""
    if os.path.isfile(path):
        raise ExportError(f"{path} is a file, and a folder of part files was asked for")
    if os.path.isdir(path) and os.listdir(path) and not os.path.exists(os.path.join(path, OURS)):
        raise ExportError(f"{path} holds files that are no earlier output; choose a new or an empty folder")


def write_folder(dealt: DataFrame, path: str) -> None:
    """Writes the column value as a folder of text files, each by a task of its own; the frame's order is that of their names and lines. It is written beside
    the place and moved there when it is whole, where only an earlier output or an empty folder may be."""
    check_folder(path)
    place = os.path.abspath(path)
    beside = f"{place}.{uuid.uuid4().hex}"
    try:
        dealt.select("value").write.option("lineSep", "\n").text(f"file://{beside}")
        with open(os.path.join(beside, OURS), "w"):
            pass
        shutil.rmtree(place, ignore_errors=True)
        os.replace(beside, place)
    except OSError as e:
        raise ExportError(f"cannot write {path}: {e}") from e
    finally:
        shutil.rmtree(beside, ignore_errors=True)


def write_json(value: dict[str, Any], path: str) -> None:
    try:
        with open(path, "w", encoding="utf-8") as f:
            f.write(json.dumps(value, ensure_ascii=False, indent=2) + "\n")
    except OSError as e:
        raise ExportError(f"cannot write {path}: {e}") from e
