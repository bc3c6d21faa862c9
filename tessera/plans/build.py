"""The build: scan, chunk, generate, validate, deduplicate, export."""

from __future__ import annotations

import os
import subprocess
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import SCHEMA_VERSION, BuildConfig, to_json
from tessera.errors import ModelError, NoChunks, NoDocuments, StageFailed
from tessera.operators import qa
from tessera.operators.cache import cache_directory, generation_key
from tessera.operators.chunking import chunk_documents, chunks_per_file
from tessera.operators.clients import ClientFactory
from tessera.operators.completions import parse_questions, questions_schema
from tessera.operators.order import numbered
from tessera.operators.prompts import QA_VERSION, load_prompt, qa_prompt
from tessera.plans.files import Written, check_folder, create_parent, write_json, write_lines
from tessera.plans.model_stage import Call, ask, now, report_others, typed
from tessera.progress import Event, Reporter, silent
from tessera.sources.repository import documents, scan

ITEMS = "array<struct<question: string, answer: string, tags: array<string>, confidence: float>>"


@dataclass(frozen=True)
class BuildResult:
    manifest: dict[str, Any]
    output: str
    manifest_path: str
    model_calls: int
    retries: int


def output_paths(output: str, parts: bool = False) -> tuple[str, str]:
    """(dataset, manifest): an existing folder holds dataset.jsonl, unless the dataset is a folder of parts; the manifest lies beside the dataset."""
    dataset = output.rstrip("/") if parts else os.path.join(output, "dataset.jsonl") if os.path.isdir(output) else output
    return dataset, os.path.join(os.path.dirname(dataset), "manifest.json")


def git_commit(repository: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", repository, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None


def generated_batches(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """chunks (with key) and the batch of their key."""
    batches = typed(answers, ITEMS).select("key", F.col("answer").alias("items"), F.col("answered_at").alias("generated_at"))
    return chunks.join(batches, "key")


def build_dataset(spark: SparkSession, config: BuildConfig, factory: ClientFactory, report: Reporter = silent) -> BuildResult:
    """Writes the dataset and its manifest. Model answers are kept in a table before anything reads them twice; tables go when their step is over."""
    config.check()
    prompt = load_prompt(QA_VERSION, config.repository, config.prompt_file)
    output, manifest_path = output_paths(config.export.output, config.export.parts)
    create_parent(output)
    if config.export.parts:
        check_folder(output)
    report(Event("discovery_started", {"repository": config.repository}))
    scanning, asking, keep = Written(spark), Written(spark), Written(spark)
    try:
        scanned = scanning(scan(spark, config.repository, config.discovery, (prompt.path,) if prompt.path else (), scanning))
        counted = scanned.agg(F.count("*").alias("n"), F.count_if(F.col("reason").isNull()).alias("read")).first()
        if not counted["read"]:
            raise NoDocuments(f"no Markdown documents in {config.repository}")
        report(Event("discovery_finished", {"discovered": counted["n"], "skipped": counted["n"] - counted["read"]}))
        docs = documents(scanned)
        g = config.generation
        ordered = numbered(chunk_documents(docs, config.chunking.max_characters), [F.split("path", "/"), F.col("chunk_ord")], "ord", asking)
        chunks = ordered.withColumn("key", generation_key(g, prompt.template)).withColumn("prompt", qa_prompt(prompt.template, g.questions_per_chunk))
        n_chunks = chunks.count()
        if report is not silent:
            for row in chunks_per_file(docs, chunks).orderBy(F.split("path", "/")).toLocalIterator():
                report(Event("file_chunked", row.asDict()))
        scanning.close()
        if not n_chunks:
            raise NoChunks("the documents have no text")
        report(Event("generation_started", {"chunks": n_chunks, "concurrency": g.concurrency}))
        cache = cache_directory(config.repository, config.cache.directory) if config.cache.enabled else None
        call = Call(factory, g.model, g.temperature, questions_schema(g.questions_per_chunk), parse_questions, g.concurrency, g.max_retries, "chunk", lambda answer: {"generated_items": len(answer)})
        places = ("path", "start_line", "end_line")
        try:
            answers = ask(chunks, call, cache, asking, report, places)
        except ModelError as e:
            raise StageFailed("{path}:{start_line}-{end_line}".format(**e.about), e) from e
        report_others(chunks.select("key", "ord", *places), answers, "chunk", n_chunks, report, {"generated_items": "items"})
        calls, retries = answers.counts()
        items = keep(qa.explode_batches(generated_batches(chunks, answers.rows), g.model))
        asking.close()
        report(Event("generation_finished", {"model_calls": calls, "retries": retries}))
        valid, _ = qa.validate(items)
        accepted = qa.first_per_question(valid)
        stats = qa.build_stats(items, n_chunks, counted["n"], counted["read"], counted["n"] - counted["read"])
        report(Event("validation_finished", {"accepted": stats["generated_items"], "rejected": stats["rejected_items"], "duplicates": stats["duplicate_items"]}))
        manifest = {
            "schema_version": SCHEMA_VERSION, "generated_at": now(), "repository": {"root": config.repository, "commit": git_commit(config.repository)}, "config": to_json(config),
            "prompt": {"version": prompt.version, "template": prompt.template}, "stats": stats,
        }
        report(Event("export_started", {"output": output}))
        write_lines(qa.json_lines(qa.alpaca(accepted, *qa.ORDER), ["instruction", "input", "output", "metadata"], *qa.ORDER), [F.col(c) for c in qa.ORDER], output, config.export.parts)
        write_json(manifest, manifest_path)
        report(Event("finished", {"output": output, "stats": stats}))
        return BuildResult(manifest, output, manifest_path, calls, retries)
    finally:
        for made in (scanning, asking, keep):
            made.close()
