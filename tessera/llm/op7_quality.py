"""Operator 7: quality by weak supervision.

Rules vote for (1) or against (-1) a document or abstain (0). Expectation-maximisation over the counts of all vote patterns of all documents
estimates each rule's accuracy on good and on bad documents, and a document's posterior probability of being good replaces a filter that
all rules must pass. There are at most 3**rules patterns, so what reaches the driver is bounded; the posterior itself is a column
expression.

A null text has no words. A document of fewer than ten words, or with more than a fifth of its words in repeated five-word windows,
fails before any vote. Repeated rows are judged alike; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernel
from tessera.llm.common import SPACE, Scratch, table
from tessera.llm.wordlists import COMMON_WORDS

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_common", "n_bare", "n_distinct", "n_upper", "n_lower", "n_letters", "n_loud", "n_adjacent"]

_ORD = np.zeros(256, bool)
_ORD[[ord(c) for c in SYMBOLS]] = True


def _word_keys(words: list[str]) -> np.ndarray:
    raw = np.frombuffer("\n".join(words).encode(), np.uint8)
    return np.unique(kernel.words(raw, np.array([0, len(raw)]), lower=False)[0])


_COMMON = _word_keys([*COMMON_WORDS, *(w.capitalize() for w in COMMON_WORDS), *(w.upper() for w in COMMON_WORDS if len(w) > 1)])


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[at])


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    raw, at = kernel.text_bytes(column)
    n_rows = len(at) - 1
    hashes, rows = kernel.words(raw, at, lower=False)
    out = {"n_words": np.bincount(rows, minlength=n_rows)}
    lead = (raw & 0xC0) != 0x80
    solid = ~kernel._IS_SPACE[raw]
    out["word_chars"] = _per_row(lead & solid, at)
    out["n_symbols"] = _per_row(_ORD[raw], at)
    h, r, first = kernel.windows(hashes, rows, n_rows, 5, short=False)
    _, inverse, times = np.unique(kernel.mix(h + r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    again = first[times[inverse] > 1]
    n = len(hashes)
    covered = np.cumsum(np.bincount(again, minlength=n + 5) - np.bincount(again + 5, minlength=n + 5))[:n] > 0
    out["n_repeat_words"] = np.bincount(rows[covered], minlength=n_rows)
    out["n_common"] = np.bincount(rows[_COMMON[np.searchsorted(_COMMON, hashes).clip(max=len(_COMMON) - 1)] == hashes], minlength=n_rows)
    out["n_adjacent"] = np.bincount(rows[1:][(hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])], minlength=n_rows)
    _, r = kernel.sets(hashes, rows, n_rows)
    out["n_distinct"] = np.bincount(r, minlength=n_rows)
    latin = np.append(False, raw[:-1] == 0xC3)[: len(raw)]
    upper = ((raw >= 65) & (raw <= 90)) | (latin & (raw >= 0x80) & (raw <= 0x9E))
    lower = ((raw >= 97) & (raw <= 122)) | (latin & (raw >= 0x9F))
    out["n_upper"], out["n_lower"] = _per_row(upper, at), _per_row(lower, at)
    letter = ((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122)) | (raw >= 0xC3)
    out["n_letters"] = _per_row(letter, at)
    out["n_loud"] = _per_row(raw == 33, at)
    before = np.append(0, np.cumsum(letter | ((raw >= 48) & (raw <= 57)), dtype=np.int64))
    begins = np.flatnonzero(solid & ~np.append(False, solid[:-1])[: len(raw)]) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(solid & ~np.append(solid[1:], False)) if len(raw) else np.zeros(0, np.int64)
    bare = begins[before[ends + 1] == before[begins]]
    out["n_bare"] = np.bincount(np.searchsorted(at, bare, side="right") - 1, minlength=n_rows)
    lines = np.zeros((3, n_rows), np.int64)
    for i, text in enumerate(column.to_pylist()):
        seen: set[str] = set()
        for line in (text or "").split("\n"):
            body = line.strip(SPACE)
            if body:
                lines[0, i] += 1
                lines[1, i] += body[-1] in ".!?:;\"')"
                lines[2, i] += line in seen
                seen.add(line)
    out["n_lines"], out["n_ended_lines"], out["n_dup_lines"] = lines
    return out


def measure(rows: DataFrame) -> DataFrame:
    """rows, which have a column text, with COUNTS, all long, in its place."""
    others = [f for f in rows.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in kernel.by_bytes(batch.column("text")):
                part = batch.slice(a, b - a)
                found = counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in others), *(pa.array(found[c], pa.int64()) for c in COUNTS)], [*(f.name for f in others), *COUNTS])

    return rows.mapInArrow(run, T.StructType([*others, *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def rules() -> dict[str, Column]:
    """Votes. Most rules know one kind of bad text and abstain otherwise; three also know what running text looks like."""
    c = {name: F.col(name).cast("double") for name in COUNTS}
    words, lines = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["n_lines"], F.lit(1.0))
    against = lambda bad: F.when(bad, -1).otherwise(0)
    cased = c["n_upper"] + c["n_lower"]
    common, ended, letters = c["n_common"] / words, c["n_ended_lines"] / lines, c["n_letters"] / F.greatest(c["word_chars"], F.lit(1.0))
    return {
        "symbols": against(c["n_symbols"] > 0.3 * words),
        "shouting": against((cased >= 20) & (c["n_upper"] > 0.4 * cased)),
        "exclaiming": against(c["n_loud"] > 0.25 * words),
        "separators": against((c["n_bare"] > 0.2 * words) & (c["n_words"] >= 10)),
        "few_distinct": against((c["n_words"] >= 50) & (c["n_distinct"] < 0.15 * words)),
        "stuttering": against((c["n_words"] >= 10) & (c["n_adjacent"] > 0.3 * words)),
        "same_lines": against((c["n_lines"] >= 4) & (c["n_dup_lines"] > 0.4 * lines)),
        "long_words": against(c["word_chars"] > 14 * words),
        "common_words": F.when(common >= 0.12, 1).when((common < 0.03) & (c["n_words"] >= 50), -1).otherwise(0),
        "ended_lines": F.when(ended >= 0.7, 1).when((ended <= 0.1) & (c["n_lines"] >= 4), -1).otherwise(0),
        "letters": F.when(letters >= 0.9, 1).when(letters < 0.6, -1).otherwise(0),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def estimate(votes: np.ndarray, weight: np.ndarray, rounds: int = 60, prior_accuracy: float = 0.85, prior_share: float = 0.05) -> tuple[float, np.ndarray]:
    """(share of good documents, chance[class, rule, vote + 1]) by expectation-maximisation; class 1 is good.

    votes: a row for each pattern, in -1, 0, 1; weight: its documents. A rule's accuracy is its chance of the right vote where it votes, and how often
    it abstains is estimated too. The prior has each rule right in prior_accuracy of its votes, at the rates at which it casts them, and counts as
    prior_share of the documents, which keeps the classes from trading places.
    """
    n_rules = votes.shape[1]
    total = weight.sum()
    is_ = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)  # patterns x rules x votes
    rate = np.tensordot(weight, is_, 1) / max(total, 1) + 1e-4
    lean = 2 * np.array([1 - prior_accuracy, 0.5, prior_accuracy])
    prior = np.stack([rate * lean[::-1], rate * lean])
    prior /= prior.sum(2, keepdims=True)
    good, chance = 0.85, prior.copy()
    for _ in range(rounds if total and n_rules else 0):
        p = posterior(votes, good, chance)
        good = float(np.clip((weight @ p + 0.85 * prior_share * total) / (total * (1 + prior_share)), 0.05, 0.95))
        for y, belief in ((1, p), (0, 1 - p)):
            seen = np.tensordot(weight * belief, is_, 1)
            # the prior's weight is what the class would get of it
            strength = prior_share * (good if y else 1 - good) * total + 1
            chance[y] = (seen + strength * prior[y]) / (seen.sum(1, keepdims=True) + strength)
    return good, chance


def weights(good: float, chance: np.ndarray) -> tuple[float, np.ndarray]:
    """Log odds of being good: of the share of good documents, and of each rule's votes."""
    return math.log(good / (1 - good)), np.log(chance[1] / chance[0])


def posterior(votes: np.ndarray, good: float, chance: np.ndarray) -> np.ndarray:
    base, odds = weights(good, chance)
    return 1 / (1 + np.exp(-(base + odds[np.arange(votes.shape[1]), votes + 1].sum(1))))


def _voted(measured: DataFrame) -> DataFrame:
    return measured.withColumns({f"v_{k}": v.cast("tinyint") for k, v in rules().items()}).withColumn("base_failed", base_failed())


def _learned(voted: DataFrame) -> Column:
    """The posterior as a column of the votes, from the votes of all documents."""
    names = [f"v_{k}" for k in rules()]
    seen = voted.where(~F.col("base_failed")).groupBy(*names).count().collect()  # 3**len(rules) rows at most
    pattern = np.array([[r[n] for n in names] for r in seen], np.int64).reshape(-1, len(names))
    base, odds_of = weights(*estimate(pattern, np.array([r["count"] for r in seen], float)))
    odds = reduce(lambda x, y: x + y, [F.element_at(F.array(*[F.lit(float(x)) for x in row]), F.col(n).cast("int") + 2) for n, row in zip(names, odds_of)], F.lit(base))
    return 1 / (1 + F.exp(-odds))


def judge(spark: SparkSession, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the five base counts, base_failed, p_good, kept."""
    voted = Scratch(spark, "quality").keep(_voted(measure(docs.select("doc_id", "text"))))
    return voted.withColumn("p_good", _learned(voted)).select("doc_id", *COUNTS[:5], "base_failed", "p_good", (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"))


def keep_good(spark: SparkSession, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, whatever their columns, that judge() keeps. Texts are measured twice, once to learn and once to filter, and never shuffled."""
    p_good = _learned(_voted(measure(docs.select("text"))))
    whole = _voted(measure(docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))))
    kept = whole.where(~F.col("base_failed") & (p_good >= threshold))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "documents"))
