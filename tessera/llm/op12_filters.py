"""Operator 12: an audit of how quality filters interact.

Whole texts are scanned as Arrow buffers: byte classes and their prefix sums count words, capitals and symbols for a batch of documents at once, and a
document's word hashes are sorted, and equal neighbours compared byte by byte, to count its distinct words. Each document comes down to a mask of
the filters that it fails and a 128-bit digest of its text; texts never leave the task that reads them. A copy is found by the digest's smallest doc_id.
Masks are then counted by part, 2**filters rows a part at most, and what every order of the filters keeps and removes is worked out from those counts.

A null text is empty. A null doc_id has no label and is no copy of anything, nor is anything a copy of it. Rows that repeat a doc_id count one by one, and
those with the smallest doc_id of their text all pass the copy filter. A label counts if any row of the doc_id has it. A null part is the empty string.
An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernel
from tessera.llm.common import SPACE, Scratch, table

#: The filters in the order of their bits: few words, repeated words, capitals, symbols, copies.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: The characters that filter D looks for.
SYMBOLS = "#$%&*|"
SCANNED = "doc_id long, part string, mask int, h1 long, h2 long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[at])


def _same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the length[i] bytes from a[i] are those from b[i]; lengths are 1 at least."""
    starts = np.cumsum(length) - length
    step = np.arange(int(length.sum())) - np.repeat(starts, length)
    return np.logical_and.reduceat(raw[np.repeat(a, length) + step] == raw[np.repeat(b, length) + step], starts) if len(a) else np.zeros(0, bool)


def distinct_words(raw: np.ndarray, hashes: np.ndarray, rows: np.ndarray, begin: np.ndarray, length: np.ndarray, n_rows: int) -> np.ndarray:
    """Distinct words of each row: its hashes in order, less those that equal the hash before. Words of equal hashes are compared; a row in which two of
    them differ is counted word by word."""
    at = np.searchsorted(rows, np.arange(n_rows + 1))
    order = np.empty(len(hashes), np.int64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):  # many short sorts are cheaper than one long one
        order[a:b] = np.argsort(hashes[a:b]) + a
    if not len(order):
        return np.zeros(n_rows, np.int64)
    h, r = hashes[order], rows[order]
    again = np.append(False, (h[1:] == h[:-1]) & (r[1:] == r[:-1]))
    out = np.bincount(r[~again], minlength=n_rows)
    this, before = order[again], order[np.flatnonzero(again) - 1]
    alike = length[this] == length[before]
    odd = set(rows[this[~alike]].tolist())
    odd |= set(rows[this[alike][~_same_bytes(raw, begin[this[alike]], begin[before[alike]], length[this[alike]])]].tolist())
    for row in odd:
        out[row] = len({raw[begin[i] : begin[i] + length[i]].tobytes() for i in range(at[row], at[row + 1])})
    return out


def failures(column: pa.Array) -> np.ndarray:
    """The mask of each text's failures in the filters A to D."""
    raw, at = kernel.text_bytes(column)
    n_rows = len(at) - 1
    hashes, rows, begin, length = kernel.word_spans(raw, at, lower=False)
    words = np.bincount(rows, minlength=n_rows)
    distinct = distinct_words(raw, hashes, rows, begin, length, n_rows)
    capitals, points, symbols = _per_row((raw >= 65) & (raw <= 90), at), _per_row((raw & 0xC0) != 0x80, at), _per_row(_SYMBOL[raw], at)
    failed = [words < 50, 100 * distinct < 65 * words, 100 * capitals > 5 * points, symbols > 0]
    return np.bitwise_or.reduce([f.astype(np.int32) << k for k, f in enumerate(failed)])


def scan(docs: DataFrame, part: str) -> DataFrame:
    """SCANNED of every document: its part, its failures but for copies, and the digest of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in kernel.by_bytes(batch.column(2)):
                piece = batch.slice(a, b - a)
                raw, at = kernel.text_bytes(piece.column(2))
                view = memoryview(raw)
                digests = np.frombuffer(b"".join(hashlib.blake2b(view[x:y], digest_size=16).digest() for x, y in zip(at[:-1].tolist(), at[1:].tolist())), np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(failures(piece.column(2)), pa.int32()), pa.array(digests[::2]), pa.array(digests[1::2])], ["doc_id", "part", "mask", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCANNED)


def count_masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic) with bit COPY in the mask of documents whose text a smaller doc_id has too.

    A document is the first of its text if its doc_id is the text's smallest: that join is by text and doc_id, so copies of one text, however many, are
    dealt by their ids. Equal rows are added up before any join.
    """
    scanned = Scratch(docs.sparkSession, "filters").keep(scan(docs, part))
    rows = scanned.groupBy("doc_id", "part", "mask", "h1", "h2").agg(F.count("*").alias("n"))
    first = scanned.where("doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = rows.join(first, ["h1", "h2", "doc_id"], "left").join(told, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("mask").bitwiseOR(F.when(copy, COPY).otherwise(0))
    times = lambda flag: F.sum(F.col("n") * F.coalesce(F.col(flag), F.lit(0))).alias(flag)
    return joined.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), times("good"), times("toxic"))


def interactions(masks: DataFrame) -> DataFrame:
    """For each part, order of the filters and step, what that step keeps and removes, from count_masks(). A part is one row of its counts by mask, from
    which its rows, a fixed number, are made."""
    steps = [(order, k + 1, sum(1 << FILTERS.index(f) for f in order[:k]), 1 << FILTERS.index(order[k])) for order in map("".join, itertools.permutations(FILTERS)) for k in range(len(order))]
    plan = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "before", "bit"), s)) for s in steps])), "array<struct<filter_order: string, step: int, before: int, bit: int>>")
    rows = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks")).select("part", "masks", F.inline(plan))
    fails = lambda m: m["mask"].bitwiseAND(F.col("bit")) != 0
    went = lambda m: m["mask"].bitwiseAND(F.col("before")) != 0
    gone = lambda m: fails(m) & ~went(m)
    total = lambda holds, of: F.aggregate("masks", F.lit(0).cast("long"), lambda t, m: t + F.when(holds(m), of(m)).otherwise(F.lit(0)).cast("long"))
    n = lambda m: m["n"]
    shares = lambda m: m["n"] * F.lit(math.factorial(len(FILTERS))) / F.bit_count(m["mask"])  # noqa: E731  a document goes by each filter that it fails in as many orders
    return rows.select(
        "part", "filter_order", "step", total(lambda m: ~fails(m) & ~went(m), n).alias("kept"), total(gone, n).alias("removed"), total(lambda m: fails(m) & went(m), n).alias("redundant"), total(lambda m: m["mask"] == F.col("bit"), n).alias("unique_fails"),
        total(gone, lambda m: m["good"]).alias("good_lost"), total(gone, lambda m: m["toxic"]).alias("toxic_lost"), total(fails, shares).alias("shapley"),
    )


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(count_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


_SPACE_CLASS = "".join(f"\\x{ord(c):02x}" for c in SPACE)
ORACLE_SQL = f"""
WITH scanned AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{_SPACE_CLASS}]+') AS words FROM documents
), first AS (
  SELECT text, min(doc_id) AS id FROM scanned GROUP BY text
), told AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(s.text, '[^A-Z]', '', 'g')) > 5 * length(s.text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(s.text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN s.doc_id > f.id THEN 'E' ELSE '' END AS fails
  FROM scanned s JOIN first f ON s.text = f.text LEFT JOIN told t ON s.doc_id = t.doc_id
), masks AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
  SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS f, substr(filter_order, 1, step::INT - 1) AS before FROM orders, range(1, 6) AS r(step)
), judged AS (
  SELECT part, filter_order, step, n, good, toxic, fails, f, contains(fails, f) AS here, length(translate(before, fails, '')) < length(before) AS went FROM masks, steps
)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (WHERE NOT here AND NOT went), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE here AND NOT went), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (WHERE here AND went), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = f), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (WHERE here AND NOT went), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE here AND NOT went), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * 120 / length(fails)) FILTER (WHERE here), 0)::BIGINT AS shapley
FROM judged GROUP BY part, filter_order, step
"""
