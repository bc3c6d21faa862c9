"""Operator 9: byte-level BPE encoding and decoding by overlapping chunks.

Texts are cut into overlapping chunks of CHUNK characters that are pre-tokenised side by side, stitched where their pre-token boundaries fall into
step (tessera.llm.bpe), and the pre-tokens are merged by the ranks; decoding concatenates the tokens' raw bytes. Only a text with code points that
the interpreter's Unicode table does not assign is left to the library whole.

A null text is an empty one and has no ids. Rows keep their own results, repeated ones too; no row is grouped with another, so neither hot
keys nor copies matter. Memory in a Python worker is bounded by a batch of texts, about a million characters in work, and the cache of
pre-tokens, which starts anew when it is full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe
from tessera.llm.common import table

CHUNK, OVERLAP = 2000, 64
_made: dict = {}


class ByteBpe:
    """Encodes as the tiktoken library's encode_ordinary does with the same ranks and pattern; decodes ids to bytes."""

    def __init__(self, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import tiktoken

        ranks = bpe.read_ranks(ranks_path)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.chunk, self.overlap = chunk, overlap
        self.cache = bpe.PieceCache(lambda pieces: [bpe.merged(p.encode("utf-8", "surrogatepass"), ranks) for p in pieces])
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = _Strings(tokens)
        self.decimals = _Strings([b"%d " % i for i in range(len(tokens))])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return bpe.batch_ids(self.cache, self.library.encode_ordinary, texts, self.chunk, self.overlap)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.tokens.joined(ids)


class _Strings:
    """Short byte strings by number, joined with numpy."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray) -> bytes:
        if not len(numbers):
            return b""
        counts = self.size[numbers]
        ends = np.cumsum(counts)
        return self.flat[np.repeat(self.begin[numbers] - (ends - counts), counts) + np.arange(int(ends[-1]))].tobytes()


def _coder(ranks_path: str, pattern: str, chunk: int, overlap: int) -> ByteBpe:
    """One for each Python worker."""
    key = (ranks_path, pattern, chunk, overlap)
    if key not in _made:
        _made[key] = ByteBpe(*key)
    return _made[key]


def public_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern, chunk, overlap)
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                ids = coder.encode([t or "" for t in part.column("text").to_pylist()])
                flat = np.concatenate([np.zeros(0, np.int32), *ids])
                at = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(at, flat)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes): the raw bytes that the ids stand for; of null ids, none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern, CHUNK, OVERLAP)
        for batch in batches:
            raw = [coder.decode(np.array(x or [], np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what encode() gives and what decode() makes of it, digested where they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern, chunk, overlap)
        for batch in batches:
            n, coded, decoded = [], [], []
            for a in range(0, len(batch), 500):
                for ids in coder.encode([t or "" for t in batch.column("text").slice(a, 500).to_pylist()]):
                    n.append(len(ids))
                    coded.append(hashlib.sha256(coder.decimals.joined(ids)[:-1]).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *public_ranks())
