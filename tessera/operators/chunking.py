"""Splits documents into chunks at headings and, where a section is too long, at line ends; ids come from content and place alone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.errors import ChunkError
from tessera.functions.markdown import heading_offsets
from tessera.functions.text import WHITE_SPACE

LANGUAGE = "markdown"


def section_spans(text: str) -> list[tuple[int, int]]:
    # a heading needs one of these characters; most long running text has none
    starts = [0, *(o for o in heading_offsets(text) if o)] if "#" in text or "\n=" in text or "\n-" in text or "=" in text or "-" in text else [0]
    starts = sorted(set(starts))
    return list(zip(starts, [*starts[1:], len(text)]))


def split_span(text: str, start: int, end: int, most: int) -> Iterator[tuple[int, int]]:
    """Spans of at most `most` characters, cut after the last line end that fits, else anywhere."""
    while end - start > most:
        cut = text.rfind("\n", start, start + most) + 1 or start + most
        yield start, cut
        start = cut
    yield start, end


def chunk_text(path: str, text: str, max_characters: int) -> list[dict]:
    """The chunks of one document, in order; pieces of white space alone are left out."""
    if max_characters <= 0:
        raise ChunkError(f"chunks of {max_characters} characters cannot hold text")
    out = []
    line, counted = 1, 0
    for a, b in section_spans(text):
        for s, e in split_span(text, a, b, max_characters):
            piece = text[s:e]
            left = len(piece) - len(piece.lstrip(WHITE_SPACE))
            body = piece.strip(WHITE_SPACE)
            if not body:
                continue
            line += text.count("\n", counted, s + left)
            counted = s + left
            last = line + body.count("\n")
            digest = hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()
            chunk_id = hashlib.sha256(f"{path}\0{line}\0{last}\0{digest}".encode("utf-8", "surrogatepass")).hexdigest()
            out.append({"chunk_id": chunk_id, "path": path, "language": LANGUAGE, "start_line": line, "end_line": last, "content_hash": digest, "text": body, "chunk_ord": len(out)})
    return out


_ARROW = pa.schema([("chunk_id", pa.string()), ("path", pa.string()), ("language", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("content_hash", pa.string()), ("text", pa.string()), ("chunk_ord", pa.int32())])


def chunk_documents(documents: DataFrame, max_characters: int = 4_000) -> DataFrame:
    """CHUNK of every document (path, text): a flat map without a shuffle, batch by batch."""
    if max_characters <= 0:
        raise ChunkError(f"chunks of {max_characters} characters cannot hold text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            size = 0
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                if text is None:
                    continue
                found = chunk_text(path, text, max_characters)
                rows += found
                size += len(text)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return documents.select("path", "text").mapInArrow(run, schemas.CHUNK)


def chunks_per_file(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every document's number of chunks, 0 too."""
    counted = chunks.groupBy("path").agg(F.count("*").alias("chunks"))
    return documents.select("path").join(counted, "path", "left").select("path", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk_id: equal pieces of one long line share their id, and a join on it must not multiply rows."""
    return chunks.dropDuplicates(["chunk_id"])
