"""Chunks of a growing folder of document tables, as a stream: the same flat map, exactly once for each file that arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera import schemas
from tessera.operators.chunking import chunk_documents


def stream_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, text) from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schemas.DOCUMENT).parquet(folder)


def write_chunks(documents: DataFrame, output: str, checkpoint: str, max_characters: int = 4_000) -> StreamingQuery:
    """Chunks what is there and ends; run again for what came since."""
    return chunk_documents(documents, max_characters).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
