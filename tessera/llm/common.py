"""What the training-data operators share: table readers and scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Characters that part words, as code points: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    files, where = _filesystem(spark, path)
    files.delete(where, True)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only where that is unset and all tasks run on this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables written once in the shared folder, so that a lost executor repeats a read and not the work before it.

    drop() removes all tables but those kept; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.made = 0
        atexit.register(self._at_exit)

    def path(self) -> str:
        self.paths.append(f"{self.root}/{self.made:03d}")
        self.made += 1
        return self.paths[-1]

    def keep(self, frame: DataFrame, rows_per_file: int = 0) -> DataFrame:
        """rows_per_file bounds what a reader of large rows holds at once; 0: no bound."""
        where = self.path()
        frame.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(where)
        return self.spark.read.schema(frame.schema).parquet(where)

    def drop(self, *paths: str) -> None:
        for path in paths or list(self.paths):
            if path in self.paths:
                self.paths.remove(path)
                delete(self.spark, path)

    def _at_exit(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # the session may be gone already
            pass
