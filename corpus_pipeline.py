"""A corpus pipeline of five training-data operators: language, quality, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. run() writes each stage's result as Parquet
in the cluster's shared folder and reads it again for the next, so a lost executor repeats a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import op3_lines, op5_language, op7_quality, op8_packing, op10_jaccard
from tessera.llm.common import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose language the network names with a probability of a half or more."""
    return op5_language.keep_identified(docs, op5_language.learn(docs), 0.5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and are more probably good than bad."""
    return op7_quality.keep_good(spark, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that are in several documents from all but the smallest doc_id; text and n_chars are those of what is left."""
    whole = docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # so that no column of docs meets one of ours
    cleaned = op3_lines.dedup_lines(whole)
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    return cleaned.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest doc_id; documents without doc_id stay. Links are at a Jaccard similarity of 0.8
    or more over windows of five words, which finds farther copies than the contract of op10's own query."""
    groups = op10_jaccard.jaccard_components(spark, docs, width=5, num=4, den=5)
    return op10_jaccard.drop_ids(docs, groups.where("doc_id <> component_id").select(F.col("doc_id").alias("id")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_packing.best_fit(spark, docs, op8_packing.public_vocabulary())


STAGES = [("language", language), ("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", packing)]

#: SQL can express neither the network nor expectation-maximisation nor packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(scratch.paths[0])
    return docs
