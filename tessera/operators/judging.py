"""Verdicts on dataset items: what can be reconstructed and judged, and what cannot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.chunking import unique_chunks

ACCEPTED, REJECTED, UNVERIFIABLE = "accepted", "rejected", "unverifiable"
NO_CHUNK = "the original source chunk could not be reconstructed"
OTHER_PLACE = "dataset provenance does not match the reconstructed source chunk"


def reconstruct(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """items with their rebuilt chunk, and unverifiable_reason where it is missing or lies elsewhere; the two reasons differ, so place is no join key."""
    fields = ("path", "start_line", "end_line", "text")
    found = unique_chunks(chunks).select("chunk_id", *[F.col(f).alias(f"_chunk_{f}") for f in fields])
    joined = items.join(found, "chunk_id", "left")
    c, s = {f: F.col(f"_chunk_{f}") for f in fields}, F.col("source")
    missing = c["path"].isNull()
    elsewhere = (c["path"] != s["path"]) | (c["start_line"] != s["start_line"]) | (c["end_line"] != s["end_line"])
    chunk = F.when(~missing, F.struct(*[c[f].alias(f) for f in fields]))
    return joined.select(*[items[k] for k in items.columns], chunk.alias("chunk"), F.when(missing, NO_CHUNK).when(elsewhere, OTHER_PLACE).alias("unverifiable_reason"))


def verdict(checks: Column) -> Column:
    passed = checks["grounded"]["passed"] & checks["self_contained"]["passed"] & checks["answer_relevant"]["passed"]
    return F.when(checks.isNull(), UNVERIFIABLE).when(passed, ACCEPTED).otherwise(REJECTED)


def py_verdict(checks: dict[str, dict]) -> str:
    """The same of a decision's checks in a task."""
    return ACCEPTED if all(check["passed"] for check in checks.values()) else REJECTED


def records(judged: DataFrame, provider: str, model: str, *keep: str) -> DataFrame:
    """Report records from items with decision (checks, evidence, verified_at) or unverifiable_reason."""
    d = F.col("decision")
    verifier = F.when(d.isNotNull(), F.struct(F.lit(provider).alias("provider"), F.lit(model).alias("model"), d["verified_at"].alias("verified_at")))
    return judged.select(
        F.col("id").alias("qa_id"), "question", "answer", "source", verdict(d["checks"]).alias("verdict"), d["checks"].alias("checks"), d["evidence"].alias("evidence"), F.col("unverifiable_reason").alias("reason"), verifier.alias("verifier"), *keep,
    )


RECORD_COLUMNS = ["qa_id", "question", "answer", "source", "verdict", "checks", "evidence", "reason", "verifier"]


def stats(records_: DataFrame) -> DataFrame:
    """One row: total, accepted, rejected, unverifiable."""
    count = lambda v: F.count_if(F.col("verdict") == v).alias(f"{v}_items")
    return records_.agg(F.count("*").alias("total_items"), count(ACCEPTED), count(REJECTED), count(UNVERIFIABLE))


def gate_fails(fail_on: str) -> Column:
    """Whether a row of stats() fails the quality gate."""
    rejected, unverifiable = F.col("rejected_items") > 0, F.col("unverifiable_items") > 0
    return {"never": F.lit(False), "rejected": rejected, "any": rejected | unverifiable}[fail_on]
