"""Operator 8: best-fit packing by sums of squares.

A piece goes where the sum over residual gaps g of N(g)**2 becomes smallest, N(g) being the number of open sequences with g free places;
ties go to the smallest gap. Only lengths matter, so pieces are tokenised and measured first, and then packed in groups of about
group_pieces pieces that are dealt by a hash of their place in the table of pieces, so that null and repeated ids meet no limit: each group is one task of bounded size, and a group wastes a few
part-filled sequences at most, which is little beside thousands of full ones. Full pieces need no search: each is a sequence. Within a
group longer pieces go first, which packs tighter and makes the result independent of the order of rows.

A null text is an empty one: its document is the separator alone. A text that spells out an added token of the vocabulary gets that token's id. Repeated rows are packed each on its own. No documents give no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import Scratch, table

_made: dict = {}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _coder(path: str):
    """One for each Python worker: the tokenizers library encodes each distinct pre-token, and whole texts whose split is unsure; ids of the vocabulary's
    added tokens, and what finds them in a text."""
    if path not in _made:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in library.get_added_tokens_decoder().values())
        finder = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        many = lambda pieces: [e.ids for e in library.encode_batch_fast(pieces, add_special_tokens=False)]
        _made[path] = (bpe.PieceCache(many), lambda text: library.encode(text, add_special_tokens=False).ids, added, finder, plain)
    return _made[path]


def encoded(vocabulary: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text as the library gives them. An added token that a text spells out is its own id, and what lies around it is encoded apart."""
    cache, whole, added, finder, plain = _coder(vocabulary)
    if finder is None or not any(map(finder.search, texts)):
        return bpe.batch_ids(cache, whole, texts)
    if not plain:  # such tokens also take or need what is beside them
        return [np.array(whole(t), np.int32) if finder.search(t) else bpe.batch_ids(cache, whole, [t])[0] for t in texts]
    parts = [finder.split(t) for t in texts]
    between = iter(bpe.batch_ids(cache, whole, [x for p in parts for x in p[::2]]))
    return [np.concatenate([np.array([added[x]], np.int32) if k % 2 else next(between) for k, x in enumerate(p)]) for p in parts]


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of capacity but the first, which may be shorter."""
    first = n_ids % capacity or min(n_ids, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n_ids, capacity)] if n_ids else []


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids, with the separator after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                found = encoded(vocabulary, [t or "" for t in part.column("text").to_pylist()])
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), found):
                    ids = np.append(ids, separator).astype("<u4")
                    rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, placed one by one."""
    n = np.zeros(capacity + 1, np.int64)  # n[g]: open bins with g free places
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled: list[int] = []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        # into gap g > size: (n[g]-1)^2 - n[g]^2 + (n[g-size]+1)^2 - n[g-size]^2; a new bin leaves capacity - size
        change = 2 * (n[: capacity + 1 - size] - n[size:]) + 2
        change[0] = 1 - 2 * n[size]
        change[n[size:] == 0] = np.iinfo(np.int64).max
        left = capacity - size
        change[left] = 2 * n[left] + 1 if left else 0
        gap = int(change.argmin()) + size
        if gap == capacity:
            b = len(filled)
            filled.append(0)
        else:
            b = open_bins[gap].pop()
            n[gap] -= 1
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        if gap > size:
            open_bins[gap - size].append(b)
            n[gap - size] += 1
    return bins, offsets


def pack(found: DataFrame, capacity: int = 2048, group_pieces: int = 20_000, n_pieces: int | None = None) -> DataFrame:
    """found with sequence_id and offset; found must be a table that reads alike each time."""
    if n_pieces is None:
        n_pieces = found.count()
    n_groups = max(1, -(-n_pieces // group_pieces))
    columns = [*found.columns, "sequence_id", "offset"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], na_position="last")
        bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
        number = int(group["_group"].iloc[0])
        return group.assign(sequence_id=bins + (number << 32), offset=offsets)[columns]

    dealt = found.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups)))
    full = found.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return dealt.where(F.col("length") < capacity).groupBy("_group").applyInPandas(run, schema).unionByName(full)


def best_fit(spark: SparkSession, docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(Scratch(spark, "packing").keep(pieces(docs, vocabulary, capacity)), capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(spark, table(spark, sf_dir, "documents"), public_vocabulary())
