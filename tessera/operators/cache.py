"""Keys of cached model answers, and where the cache lies."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import GenerationConfig, VerifierConfig


def cache_directory(repository: str, directory: str, verify: bool = False) -> str:
    where = os.path.join(repository, directory)
    return os.path.join(where, "verify") if verify else where


def _key(fields: dict[str, Column]) -> Column:
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"}), 256)


def generation_key(config: GenerationConfig, template: str) -> Column:
    """Changes with the chunk, the prompt, the model, and how it is asked; not with concurrency, retries or output."""
    return _key({"chunk_id": F.col("chunk_id"), "prompt_hash": F.sha2(F.lit(template), 256), "provider": F.lit(config.provider), "model": F.lit(config.model), "endpoint": F.lit(config.endpoint).cast("string"), "questions_per_chunk": F.lit(config.questions_per_chunk), "temperature": F.lit(config.temperature).cast("float")})


def verification_key(config: VerifierConfig, template: str) -> Column:
    return _key({"qa_id": F.col("id"), "question": F.col("question"), "answer": F.col("answer"), "chunk_id": F.col("chunk_id"), "prompt_hash": F.sha2(F.lit(template), 256), "provider": F.lit(config.provider), "model": F.lit(config.model), "endpoint": F.lit(config.endpoint).cast("string"), "temperature": F.lit(config.temperature).cast("float")})
