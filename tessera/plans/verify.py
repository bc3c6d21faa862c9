"""The verification: read the dataset, rebuild its chunks, join, judge, report."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import SCHEMA_VERSION, VerificationConfig, build_config_from_json, to_json
from tessera.errors import ModelError, StageFailed
from tessera.operators import judging
from tessera.operators.cache import cache_directory, verification_key
from tessera.operators.chunking import chunk_documents
from tessera.operators.clients import ClientFactory
from tessera.operators.completions import decision_schema, parse_decision
from tessera.operators.prompts import VERIFY_VERSION, load_prompt, verification_prompt
from tessera.operators.qa import json_lines
from tessera.plans.files import Written, check_folder, create_parent, write_json, write_lines
from tessera.plans.model_stage import Call, ask, now, report_others, typed
from tessera.progress import Event, Reporter, silent
from tessera.sources.dataset import read_dataset, read_manifest

DECISION = "struct<checks: " + schemas.CHECKS.simpleString() + ", evidence: string>"


@dataclass(frozen=True)
class VerificationOutcome:
    stats: dict[str, int]
    output: str
    manifest_path: str
    model_calls: int
    retries: int


def source_path(repository: str, path: str) -> str | None:
    """The file of a source path, if that is relative, inside the repository, and a file."""
    if os.path.isabs(path):
        return None
    root, full = os.path.realpath(repository), os.path.realpath(os.path.join(repository, path))
    return full if os.path.commonpath([root, full]) == root and os.path.isfile(full) else None


def referenced_documents(items: DataFrame, repository: str, max_bytes: int) -> DataFrame:
    """(path, text) of the files that items refer to; files that are missing, outside, too large or not UTF-8 are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                full = source_path(repository, path)
                try:
                    if full is None or os.path.getsize(full) > max_bytes:
                        continue
                    with open(full, "rb") as f:
                        rows.append((path, f.read().decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")))
                except (OSError, UnicodeDecodeError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["path", "text"])

    # the number of tasks is stated: paths are so few bytes that Spark would take them together, and one task would read all files
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return items.select("source.path").repartition(tasks, "path").distinct().mapInArrow(run, "path string, text string")


def verify_dataset(spark: SparkSession, config: VerificationConfig, factory: ClientFactory, report: Reporter = silent) -> VerificationOutcome:
    """Writes the report and its manifest; the dataset itself is only read. Tables go when their step is over."""
    config.check()
    source_build = read_manifest(config.build_manifest)
    build = build_config_from_json(source_build["config"])
    v = config.verifier
    output = config.output.rstrip("/") if config.parts else config.output
    if config.parts:
        check_folder(output)
    reading, asking, keep = Written(spark), Written(spark), Written(spark)
    try:
        items = reading(read_dataset(spark, config.dataset, reading))
        prompt = load_prompt(VERIFY_VERSION, config.repository, config.prompt_file)
        report(Event("verification_started", {"dataset": config.dataset}))
        chunks = chunk_documents(referenced_documents(items, config.repository, build.discovery.max_bytes_per_file), build.chunking.max_characters)
        rebuilt = asking(judging.reconstruct(items, chunks).withColumn("key", verification_key(v, prompt.template)))
        reading.close()
        wanted = rebuilt.where("unverifiable_reason IS NULL")
        report(Event("reconstructed", {"items": wanted.count()}))
        requests = wanted.select("key", "item_ord", F.col("id").alias("qa_id"), verification_prompt(prompt.template, "chunk.").alias("prompt")).withColumnRenamed("item_ord", "ord")
        cache = cache_directory(config.repository, config.cache.directory, verify=True) if config.cache.enabled else None
        call = Call(factory, v.model, v.temperature, decision_schema(), parse_decision, v.concurrency, v.max_retries, "item", lambda answer: {"verdict": judging.py_verdict(answer["checks"])})
        try:
            answers = ask(requests, call, cache, asking, report, ("qa_id",))
        except ModelError as e:
            raise StageFailed(f"item {e.about['qa_id']}", e) from e
        calls, retries = answers.counts()
        decisions = typed(answers.rows, DECISION).select("key", F.struct(F.col("answer.checks").alias("checks"), F.col("answer.evidence").alias("evidence"), F.col("answered_at").alias("verified_at")).alias("decision"))
        judged = rebuilt.join(decisions, "key", "left").withColumn("decision", F.when(F.col("unverifiable_reason").isNull(), F.col("decision")))
        found = keep(judging.records(judged, v.provider, v.model, "item_ord", "key"))
        stats = judging.stats(found).first().asDict()
        report_others(found.select("key", F.col("item_ord").alias("ord"), "qa_id", "verdict"), answers, "item", stats["total_items"], report, {"verdict": "verdict"})
        asking.close()
        report(Event("verification_finished", stats | {"model_calls": calls}))
        create_parent(output)
        write_lines(json_lines(found, judging.RECORD_COLUMNS, "item_ord"), [F.col("item_ord")], output, config.parts)
        manifest_path = os.path.join(os.path.dirname(output), "verification-manifest.json")
        manifest: dict[str, Any] = {"schema_version": SCHEMA_VERSION, "verified_at": now(), "config": to_json(config), "prompt": {"version": prompt.version, "template": prompt.template}, "source_build": source_build, "stats": stats}
        write_json(manifest, manifest_path)
        report(Event("report_written", {"output": output}))
        return VerificationOutcome(stats, output, manifest_path, calls, retries)
    finally:
        for made in (reading, asking, keep):
            made.close()


def fails_gate(stats: dict[str, int], fail_on: str) -> bool:
    return fail_on == "rejected" and stats["rejected_items"] > 0 or fail_on == "any" and stats["rejected_items"] + stats["unverifiable_items"] > 0
