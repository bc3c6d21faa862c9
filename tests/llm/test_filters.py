"""The audit of filter interactions against a plain version, on awkward rows."""

import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import kernel
from tessera.llm import op12_filters as filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i}" for i in range(70))
ROWS = [
    (1, LONG, "a"), (2, LONG, "b"), (2, LONG, "b"), (3, LONG, None), (None, LONG, "a"), (4, None, "a"), (5, "", "b"), (6, " \t\x0b\n", "b"), (7, "Word word " * 40, "c"), (8, LONG + " $", "a"), (9, LONG.upper(), "a"), (10, "é# " * 60, "c"),
    (11, LONG + " É\x85 end", ""), (None, "x", None), (12, "x", None), (-1, LONG, "b"), (13, "A" * 30_000 + "|", "c"), (14, " ".join(f"w{i % 39}" for i in range(60)), "d"), (15, " ".join(f"w{i % 38}" for i in range(60)), "d"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (None, 1, 1), (4, 0, 1), (5, 1, None), (9, 1, 1), (15, 1, 0), (99, 1, 1)]


def brute(rows, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    ids = collections.defaultdict(set)
    for d, text, _ in rows:
        if d is not None:
            ids[text or ""].add(d)
    judged = []
    for d, text, part in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and min(ids[text]) < d}
        judged.append((part or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    out = {}
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        shares, found = collections.Counter(), {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(range(len(mine)))
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in mine[i][1]]
                before = set(range(len(mine))) - set(left)
                left = [i for i in left if f not in mine[i][1]]
                shares[f] += len(gone)
                found[part, order, step] = (len(left), len(gone), sum(f in mine[i][1] for i in before), sum(m[1] == {f} for m in mine), sum(mine[i][2] for i in gone), sum(mine[i][3] for i in gone))
        out |= {k: (*v, shares[k[1][k[2] - 1]]) for k, v in found.items()}
    return out


def audit(docs, labels):
    return {tuple(r)[:3]: tuple(r)[3:] for r in filters.interactions(filters.count_masks(docs, labels)).collect()}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").select("*", F.lit(1).alias("mask"), F.lit("x").alias("part"), F.lit(2).alias("n"), F.lit(0).alias("h1"), F.lit(0).alias("first"))
    return docs.repartition(3), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x"))


def test_whole_audit(tables):
    assert audit(*tables) == brute(ROWS, LABELS)


def test_empty_tables(tables):
    docs, labels = tables
    assert audit(docs.limit(0), labels) == {}
    assert audit(docs, labels.limit(0)) == brute(ROWS, [])


def test_distinct_words_survive_hash_collisions():
    text = "aa bb aa cc\tbb dd aa".encode()
    raw, at = np.frombuffer(text + b"xx yy xx", np.uint8), np.array([0, len(text), len(text) + 8])
    h, rows, begin, length = kernel.word_spans(raw, at, lower=False)
    assert filters.distinct_words(raw, h, rows, begin, length, 2).tolist() == [4, 2]
    assert filters.distinct_words(raw, np.zeros_like(h), rows, begin, length, 2).tolist() == [4, 2]
    assert filters.distinct_words(raw, h % np.uint64(2), rows, begin, length, 2).tolist() == [4, 2]


def test_scan_failures_do_not_hang_on_batches(tables):
    column = kernel.pa.array([r[1] for r in ROWS], kernel.pa.string())
    whole = filters.failures(column).tolist()
    assert whole == [int(filters.failures(column.slice(i, 1))[0]) for i in range(len(ROWS))]
    assert filters.failures(column.slice(0, 0)).tolist() == []
