"""Reads what a build wrote: the JSONL dataset, strictly and line by line, and the manifest."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import schemas
from tessera.errors import DatasetError
from tessera.operators.completions import json_loads, number, text_of, texts_of

PARSED = "file string, block long, at long, error string, record struct<" + ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in schemas.ALPACA) + ">"


def parse_record(line: str) -> dict[str, Any]:
    """An Alpaca record with its types as they must be; unknown fields are ignored."""
    raw = json_loads(line)
    if type(raw) is not dict:
        raise ValueError("a record must be an object")
    meta = raw.get("metadata")
    if type(meta) is not dict or type(meta.get("source")) is not dict:
        raise ValueError("metadata with its source is missing")
    source = meta["source"]
    for name in ("start_line", "end_line"):
        if type(source.get(name)) is not int or source[name] < 0:
            raise ValueError(f"source.{name} must be a whole number")
    return {
        "instruction": text_of(raw, "instruction"), "input": text_of(raw, "input"), "output": text_of(raw, "output"),
        "metadata": {
            "id": text_of(meta, "id"), "source": {"path": text_of(source, "path"), "start_line": source["start_line"], "end_line": source["end_line"]},
            "chunk_id": text_of(meta, "chunk_id"), "model": text_of(meta, "model"), "generated_at": text_of(meta, "generated_at"), "tags": texts_of(meta, "tags"), "confidence": number(meta, "confidence"),
        },
    }


def numbered_records(spark: SparkSession, path: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(line, error, record) of each line of a dataset, from 1; a line has either a record or what is wrong with it.

    path is one file, or a folder of part files, which follow one another by the lengths of their names, then by name. Every split is parsed once and kept (keep writes a table and reads it again);
    lines are numbered within their split, and splits, a row each, are counted, put in order and joined, to tell how many lines lie before.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))

    def parse(batches):
        for batch in batches:
            rows = []
            for value, *place in zip(batch["value"], batch["file"], batch["block"], batch["at"]):
                try:
                    if not value.strip():
                        raise ValueError("blank line")
                    rows.append((*place, None, parse_record(value)))
                except ValueError as e:
                    rows.append((*place, str(e) or "malformed", None))
            yield pd.DataFrame(rows, columns=["file", "block", "at", "error", "record"])

    parsed = keep(lines.mapInPandas(parse, PARSED))
    splits = parsed.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.length("file"), "file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parsed.join(splits.select("file", "block", (before - F.col("first_at")).alias("shift")), ["file", "block"]).select((F.col("at") + F.col("shift") + 1).alias("line"), "error", "record")


def read_dataset(spark: SparkSession, path: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The dataset's QA items with item_ord, the number of the line before; a blank or malformed line, or no line, is an error with its number."""
    numbered = numbered_records(spark, path, keep)
    bad = numbered.where("error IS NOT NULL").orderBy("line").select("error", "line").limit(1).collect()
    if bad:
        raise DatasetError(bad[0]["error"], bad[0]["line"])
    if numbered.isEmpty():
        raise DatasetError("the dataset has no records")
    meta = F.col("record.metadata")
    return numbered.select(
        (F.col("line") - 1).alias("item_ord"), meta["id"].alias("id"), F.col("record.instruction").alias("question"), F.col("record.output").alias("answer"), meta["source"].alias("source"), meta["chunk_id"].alias("chunk_id"),
        meta["model"].alias("model"), meta["generated_at"].alias("generated_at"), F.coalesce(meta["tags"], F.array().cast("array<string>")).alias("tags"), meta["confidence"].alias("confidence"),
    )


def read_manifest(path: str) -> dict[str, Any]:
    try:
        with open(path, encoding="utf-8") as f:
            raw = json_loads(f.read())
    except (OSError, ValueError) as e:
        raise DatasetError(f"cannot read the build manifest {path}: {e}") from e
    missing = {"schema_version", "generated_at", "repository", "config", "prompt", "stats"} - set(raw if isinstance(raw, dict) else ())
    if missing:
        raise DatasetError(f"the build manifest lacks {', '.join(sorted(missing))}")
    return raw


def dumps(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
