"""Question-and-answer items: made from generated batches, validated, deduplicated, exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions.text import is_blank, normalize_question, sha256_joined, trim
from tessera.operators.order import order_number

#: Items in order: the number of their chunk, then their place in its batch.
ORDER = ["ord", "item_ord"]
REASONS = ("empty_question", "empty_answer", "empty_source_path", "invalid_source_range", "empty_chunk_id", "invalid_confidence")


def qa_id(chunk_id: Column, question: Column) -> Column:
    return sha256_joined(chunk_id, normalize_question(question))


def explode_batches(batches: DataFrame, model: str) -> DataFrame:
    """QA with its order, from chunks with their batch (generated_at, items), and their number (ord) if they have one."""
    known = [c for c in ("ord",) if c in batches.columns]
    rows = batches.select("chunk_id", "path", "start_line", "end_line", *known, "generated_at", F.posexplode("items").alias("item_ord", "item"))
    question = trim(F.col("item.question"))
    tags = F.filter(F.transform("item.tags", trim), lambda t: t != "")
    return rows.select(
        qa_id(F.col("chunk_id"), question).alias("id"), question.alias("question"), trim(F.col("item.answer")).alias("answer"), F.struct("path", "start_line", "end_line").alias("source"), "chunk_id", F.lit(model).alias("model"),
        "generated_at", tags.alias("tags"), F.col("item.confidence").alias("confidence"), *known, "item_ord",
    )


def reject_reason() -> Column:
    """The first reason to reject an item, null for none."""
    start, end, confidence = F.col("source.start_line"), F.col("source.end_line"), F.col("confidence")
    failed = [
        is_blank(F.col("question")), is_blank(F.col("answer")), is_blank(F.col("source.path")), (start == 0) | (end < start), is_blank(F.col("chunk_id")),
        confidence.isNotNull() & ~confidence.between(0.0, 1.0),
    ]
    reason = F.when(failed[0], REASONS[0])
    for condition, name in zip(failed[1:], REASONS[1:]):
        reason = reason.when(condition, name)
    return reason


def validate(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reject_reason)."""
    judged = items.withColumn("reject_reason", reject_reason())
    return judged.where("reject_reason IS NULL").drop("reject_reason"), judged.where("reject_reason IS NOT NULL")


def first_per_question(valid: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """The first item of each normalised question over the whole corpus. order: integer columns that tell items apart, all but the first from 0 to 2**32 - 1.

    First, 128-bit hashes of questions and a number of fixed width are aggregated by hash, which keeps one number for each question and task; then items are
    joined with the numbers that are left. No item is in an aggregation buffer, and a question that everyone asks makes no hot task in either step.
    """
    key = normalize_question(F.col("question"))
    keyed = valid.withColumns({"_h1": F.xxhash64(key), "_h2": F.xxhash64(F.lit(1), key), "_number": order_number(order)})
    first = keyed.groupBy("_h1", "_h2").agg(F.min("_number").alias("_number"))
    return keyed.join(first, ["_number", "_h1", "_h2"], "left_semi").select(*valid.columns)


def item_counts(items: DataFrame) -> DataFrame:
    """One row: generated_items, rejected_items, duplicate_items. Items are counted by question first, rejected ones together under none."""
    valid = reject_reason().isNull()
    by_question = items.groupBy(F.when(valid, normalize_question(F.col("question"))).alias("q")).agg(F.count("*").alias("n"))
    accepted, n_valid = F.count("q"), F.coalesce(F.sum(F.when(F.col("q").isNotNull(), F.col("n"))), F.lit(0))
    rejected = F.coalesce(F.sum(F.when(F.col("q").isNull(), F.col("n"))), F.lit(0))
    return by_question.agg(accepted.alias("generated_items"), rejected.alias("rejected_items"), (n_valid - accepted).alias("duplicate_items"))


def build_stats(items: DataFrame, n_chunks: int, discovered: int, processed: int, skipped: int) -> dict[str, int]:
    """Counts of a build from one aggregation over the generated items."""
    return {"discovered_files": discovered, "processed_files": processed, "skipped_files": skipped, "chunks": n_chunks} | item_counts(items).first().asDict()


def alpaca(items: DataFrame, *keep: str) -> DataFrame:
    """ALPACA records; empty tags are null, so that JSON leaves them out."""
    meta = F.struct("id", "source", "chunk_id", "model", "generated_at", F.when(F.size("tags") > 0, F.col("tags")).alias("tags"), "confidence")
    return items.select(F.col("question").alias("instruction"), F.lit("").alias("input"), F.col("answer").alias("output"), meta.alias("metadata"), *keep)


def from_alpaca(records: DataFrame, *keep: str) -> DataFrame:
    m = F.col("metadata")
    return records.select(m["id"].alias("id"), F.col("instruction").alias("question"), F.col("output").alias("answer"), m["source"].alias("source"), m["chunk_id"].alias("chunk_id"), m["model"].alias("model"), m["generated_at"].alias("generated_at"), F.coalesce(m["tags"], F.array().cast("array<string>")).alias("tags"), m["confidence"].alias("confidence"), *keep)


def json_lines(records: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """(value, ...): each record as compact JSON; nulls are left out."""
    return records.select(F.to_json(F.struct(*columns)).alias("value"), *keep)


QA_COLUMNS = schemas.QA.fieldNames()
