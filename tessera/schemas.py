"""Schemas of the engine's tables. Timestamps are RFC 3339 strings, kept as they were written."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _F, _B, _I = T.StringType(), T.LongType(), T.FloatType(), T.BooleanType(), T.IntegerType()


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


DOCUMENT = _struct(("path", _S, False), ("text", _S, False))
SCANNED = _struct(("path", _S, False), ("file_ord", _L, False), ("text", _S, True), ("reason", _S, True), ("bytes", _L, True), ("max_bytes", _L, True))
SKIPPED = _struct(("path", _S, False), ("reason", _S, False), ("bytes", _L, True), ("max_bytes", _L, True))
SOURCE_REF = _struct(("path", _S, False), ("start_line", _L, False), ("end_line", _L, False))
CHUNK = _struct(("chunk_id", _S, False), ("path", _S, False), ("language", _S, False), ("start_line", _L, False), ("end_line", _L, False), ("content_hash", _S, False), ("text", _S, False), ("chunk_ord", _I, False))
TAGS = T.ArrayType(_S, False)
GENERATED_QA = _struct(("question", _S, False), ("answer", _S, False), ("tags", TAGS, False), ("confidence", _F, True))
BATCH = _struct(("generated_at", _S, False), ("items", T.ArrayType(GENERATED_QA, False), False))
QA = _struct(("id", _S, False), ("question", _S, False), ("answer", _S, False), ("source", SOURCE_REF, False), ("chunk_id", _S, False), ("model", _S, False), ("generated_at", _S, False), ("tags", TAGS, False), ("confidence", _F, True))
METADATA = _struct(("id", _S, False), ("source", SOURCE_REF, False), ("chunk_id", _S, False), ("model", _S, False), ("generated_at", _S, False), ("tags", TAGS, True), ("confidence", _F, True))
ALPACA = _struct(("instruction", _S, False), ("input", _S, False), ("output", _S, False), ("metadata", METADATA, False))
CHECK = _struct(("passed", _B, False), ("reason", _S, False))
CHECKS = _struct(("grounded", CHECK, False), ("self_contained", CHECK, False), ("answer_relevant", CHECK, False))
DECISION = _struct(("checks", CHECKS, False), ("evidence", _S, True), ("verified_at", _S, False))
VERIFIER = _struct(("provider", _S, False), ("model", _S, False), ("verified_at", _S, False))
