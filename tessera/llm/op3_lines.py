"""Operator 3: line deduplication across documents.

Lines are exploded and normalised to keys, keys are hashed (two 64-bit hashes with different seeds, 128 bits), and a partial aggregation
finds for each hash the smallest and largest document that holds it: it is in two documents where these differ. Lines with such a key go
from every document but the smallest; what is left is put together by position. Only (document, position, hash) is shuffled by hash. Lines that are
HOT_SHARE of all lines in several documents or more, at most 1 / HOT_SHARE keys, are looked up in a broadcast table and then dealt evenly, so that no task gets
all rows of a hot line; texts are shuffled once, by document.

A null or empty text is one empty line. Rows with a null doc_id count for no document and lose nothing. Rows that repeat a doc_id count as one
document, and each loses its own lines. Other columns pass by untouched.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, Scratch, table

HOT_SHARE = 1 / 2000


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def dropped_positions(docs: DataFrame, min_chars: int = 10, min_documents: int = 2) -> DataFrame:
    """(_doc, _text, _dropped): positions of the lines that go, for the documents that lose any. _text is a hash of the text."""
    exploded = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"), F.posexplode(lines(F.col("text"))).alias("_at", "_line"))
    key = line_key(F.col("_line"))
    keyed = exploded.where(F.length(key) >= min_chars).select("_doc", "_text", "_at", F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(1), key).alias("_h2"))
    by_key = keyed.groupBy("_h1", "_h2").agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last"), F.count("*").alias("_n"))
    if min_documents == 2:
        common = by_key.where("_first < _last")
    else:
        holders = keyed.select("_h1", "_h2", "_doc").distinct().groupBy("_h1", "_h2").agg(F.count("*").alias("_docs")).where(F.col("_docs") >= min_documents)
        common = by_key.join(holders.select("_h1", "_h2"), ["_h1", "_h2"], "left_semi")
    common = Scratch(docs.sparkSession, "lines").keep(common.select("_h1", "_h2", "_first", "_n"))
    least = F.lit(HOT_SHARE * (common.agg(F.sum("_n")).first()[0] or 0))
    hot = common.where(F.col("_n") >= least).select("_h1", "_h2", F.col("_first").alias("_hot"))
    cold = common.where(F.col("_n") < least).select(F.col("_h1").alias("_k"), "_h2", "_first")
    dealt = keyed.join(F.broadcast(hot), ["_h1", "_h2"], "left").withColumn("_k", F.when(F.col("_hot").isNull(), F.col("_h1")).otherwise(F.xxhash64("_doc", "_at")))
    gone = dealt.join(cold, ["_k", "_h2"], "left").withColumn("_first", F.coalesce("_hot", "_first")).where("_doc <> _first")
    return gone.groupBy("_doc", "_text").agg(F.collect_set("_at").alias("_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_documents: int = 2) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text, in place of columns of these names."""
    gone = dropped_positions(docs, min_chars, min_documents)
    joined = docs.join(gone, (docs["doc_id"] == gone["_doc"]) & (F.xxhash64(docs["text"]) == gone["_text"]), "left")
    split, dropped = lines(docs["text"]), gone["_dropped"]
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), dropped)
    kept = F.when(dropped.isNull(), F.coalesce(docs["text"], F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n"))
    made = {"n_lines": F.size(split).cast("long"), "n_dropped": F.coalesce(F.size(dropped), F.lit(0)).cast("long"), "kept_text": kept}
    return joined.select(*[docs[c] for c in docs.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, i, list_extract(parts, i) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) t, unnest(range(1, len(parts) + 1)) AS u(i)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.i, k.line, c.key IS NOT NULL AND k.doc_id <> c.first AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
