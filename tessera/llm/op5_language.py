"""Operator 5: language identification by a byte convolutional network.

Bytes are embedded; filters of several widths run over fixed-length windows, their largest answers feed a softmax. The network is trained
in numpy on windows of labelled texts and applied to all windows of every whole text in batches; a document's probabilities are
the mean over its windows, weighted by their bytes.

The training sample is bounded: at most max_sample documents in all (one of each where there are more languages), shared evenly by the languages and
chosen by hashes of their texts, so that a text counts once for a language, four windows of each. It is the only thing that reaches the driver. A null text, or one without a letter (category L), is "und" with score 0, and so is every text
when nothing is labelled. Repeated rows get equal answers; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import kernel
from tessera.llm.common import Scratch, table

WINDOW = 256
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Net:
    languages: list[str]
    embedding: np.ndarray  # 256 x E
    filters: list[np.ndarray]  # each (width * E) x F
    biases: list[np.ndarray]
    dense: np.ndarray  # (widths * F) x languages
    bias: np.ndarray

    def _stacked(self, flat: np.ndarray, width: int) -> np.ndarray:
        """The embeddings of every width bytes, one row each."""
        n, length, size = flat.shape
        view = np.lib.stride_tricks.sliding_window_view(flat.reshape(n, length * size), width * size, axis=1)[:, ::size]
        return np.ascontiguousarray(view).reshape(-1, width * size)

    def pooled(self, windows: np.ndarray, keep: bool = False):
        x = self.embedding[windows]
        out, saved = [], []
        for w, b in zip(self.filters, self.biases):
            width = w.shape[0] // x.shape[2]
            cols = self._stacked(x, width)
            answers = (cols @ w).reshape(len(windows), -1, w.shape[1])
            best = answers.max(1)
            out.append(np.maximum(best + b, 0))
            if keep:
                saved.append((width, answers.argmax(1)))
        return np.concatenate(out, 1), x, saved

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows)[0] @ self.dense + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], widths=(2, 3, 4), n_filters: int = 16, size: int = 8, epochs: int = 6, rate: float = 0.01, seed: int = 7) -> Net:
    """Adam on the cross entropy; the gradient flows through the place of each filter's largest answer."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Net(languages, normal(256, size, scale=0.5), [normal(w * size, n_filters, scale=(2 / (w * size)) ** 0.5) for w in widths], [np.zeros(n_filters, np.float32) for _ in widths], normal(len(widths) * n_filters, len(languages), scale=0.2), np.zeros(len(languages), np.float32))
    parameters = [net.embedding, *net.filters, *net.biases, net.dense, net.bias]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), 64):
            rows = order[a : a + 64]
            h, x, saved = net.pooled(windows[rows], keep=True)
            z = h @ net.dense + net.bias
            z = np.exp(z - z.max(1, keepdims=True))
            dz = z / z.sum(1, keepdims=True)
            dz[np.arange(len(rows)), labels[rows]] -= 1
            dz /= len(rows)
            dh = (dz @ net.dense.T) * (h > 0)
            d_embedding = np.zeros_like(net.embedding)
            d_filters, d_biases = [], []
            for k, (width, place) in enumerate(saved):
                g = dh[:, k * n_filters : (k + 1) * n_filters]
                d_biases.append(g.sum(0))
                spots = place[:, :, None] + np.arange(width)  # rows x filters x width
                taken = x[np.arange(len(rows))[:, None, None], spots]  # ... x size
                d_filters.append(np.einsum("nf,nfws->wsf", g, taken).reshape(width * size, n_filters))
                back = np.einsum("nf,wsf->nfws", g, net.filters[k].reshape(width, size, n_filters))
                np.add.at(d_embedding, windows[rows][np.arange(len(rows))[:, None, None], spots], back)
            gradients = [d_embedding, *d_filters, *d_biases, h.T @ dz, dz.sum(0)]
            step += 1
            for p, g, m, v in zip(parameters, gradients, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3


def sample(docs: DataFrame, max_sample: int = 1600) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of at most max_sample labelled texts (of one for each language at least), their labels, and the languages that have any.

    A text counts once for a language, however often it is there: texts are grouped by their hashes, and each language's first in the order of hashes
    are taken, as many of each as share max_sample evenly. Only these few are cut into windows.
    """
    labelled = docs.where((F.length("text") > 0) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder() != 1)).select("lang", "text", F.xxhash64("text").alias("h"))
    texts = labelled.groupBy("lang", "h").agg(F.count("*").alias("n"))
    order = [F.xxhash64("h"), F.col("h")]
    parts = texts.withColumn("part", F.pmod("h", F.lit(64)))  # so that what one task ranks of a language does not grow with the table
    for of in (["lang", "part"], ["lang"]):
        parts = parts.withColumn("r", F.row_number().over(Window.partitionBy(*of).orderBy(*order))).where(F.col("r") <= max_sample)
    first = Scratch(docs.sparkSession, "language").keep(parts.select("lang", "h", "r"))
    ranked = first.groupBy("lang").agg(F.max("r").alias("n"))
    n_languages = ranked.count()
    if not n_languages:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    each = max(1, max_sample // n_languages)
    chosen = first.where(F.col("r") <= each).select("lang", "h")  # max_sample rows, or one for each language
    at = lambda j: F.substring("text", 1 + F.pmod(F.xxhash64("h", F.lit(j)), F.greatest(F.lit(1), F.length("text") - 200)).cast("int"), F.lit(WINDOW))
    cut = labelled.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", F.array(*[at(j) for j in range(4)]).alias("parts")).dropDuplicates(["lang", "h"])
    rows = sorted(cut.collect(), key=lambda r: (r["h"], r["lang"]))
    languages = sorted({r["lang"] for r in rows})
    windows, labels = [], []
    for r in rows:
        for part in r["parts"]:
            raw = part.encode()[:WINDOW]
            windows.append(np.frombuffer(raw.ljust(WINDOW, b"\0"), np.uint8))
            labels.append(languages.index(r["lang"]))
    return np.array(windows).reshape(-1, WINDOW), np.array(labels), languages


def learn(docs: DataFrame, max_sample: int = 1600) -> Net | None:
    """A network, or None if nothing is labelled. Languages with fewer windows than others see theirs as often in all as the others."""
    windows, labels, languages = sample(docs, max_sample)
    if not len(windows):
        return None
    most = int(np.bincount(labels).max())
    even = np.concatenate([np.resize(np.flatnonzero(labels == k), most) for k in range(len(languages))])
    return train(windows[even], labels[even], languages)


def predict_texts(net: Net, column: pa.Array, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(language number, probability) of each text, from all its windows."""
    raw, at = kernel.text_bytes(column)
    sizes = np.diff(at)
    per = -(-sizes // WINDOW)
    rows = np.repeat(np.arange(len(sizes)), per)
    begin = at[:-1][rows] + (np.arange(len(rows)) - np.repeat(np.cumsum(per) - per, per)) * WINDOW
    total = np.zeros((len(sizes), len(net.languages)))
    padded = np.append(raw, np.zeros(WINDOW, np.uint8))
    for a in range(0, len(rows), at_once):
        r, s = rows[a : a + at_once], begin[a : a + at_once]
        length = np.minimum(at[r + 1] - s, WINDOW)
        windows = padded[s[:, None] + np.arange(WINDOW)]
        windows[np.arange(WINDOW) >= length[:, None]] = 0
        np.add.at(total, r, net.probabilities(windows) * length[:, None])
    total /= np.maximum(sizes, 1)[:, None]
    best = total.argmax(1)
    return best, np.clip(total[np.arange(len(best)), best], 0, 1)


def identify(docs: DataFrame, net: Net | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in kernel.by_bytes(batch.column("text")):
                part = batch.slice(a, b - a)
                lettered = [bool(t and _LETTER.search(t)) for t in part.column("text").to_pylist()]
                if net is None:
                    names, scores = ["und"] * len(part), [0.0] * len(part)
                else:
                    best, p = predict_texts(net, part.column("text"))
                    names = [net.languages[k] if ok else "und" for k, ok in zip(best.tolist(), lettered)]
                    scores = [x if ok else 0.0 for x, ok in zip(p.tolist(), lettered)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: Net | None, min_score: float) -> DataFrame:
    """The rows of docs, whatever their columns, whose language is not "und" and has a probability of min_score or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in kernel.by_bytes(batch.column("text")):
                part = batch.slice(a, b - a)
                lettered = np.array([bool(t and _LETTER.search(t)) for t in part.column("text").to_pylist()], bool)
                if net is not None:
                    lettered &= predict_texts(net, part.column("text"))[1] >= min_score
                    yield part.filter(pa.array(lettered))

    return docs.mapInArrow(run, docs.schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder() == 1, F.lit(False))
    return identify(docs, learn(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
