"""Settings of the two dataflows and their checks. They live on the driver and are what manifests record; API keys are never among them."""

from __future__ import annotations

import dataclasses
import math
from dataclasses import dataclass, field
from typing import Any

from tessera.errors import ConfigError

SCHEMA_VERSION = "1"
CACHE_DIRECTORY = ".tessera"
DEFAULT_MODEL = "llama3.2"
PROVIDERS = {"ollama": "http://localhost:11434", "open_ai_compatible": "https://api.openai.com/v1"}
INPUT_SCOPES = ("docs", "code", "all")
FAIL_ON = ("never", "rejected", "any")


@dataclass(frozen=True)
class DiscoveryConfig:
    respect_gitignore: bool = True
    ignore_files: tuple[str, ...] = ()
    max_files: int | None = None
    max_bytes_per_file: int = 1_000_000
    excluded_names: tuple[str, ...] = (".git", CACHE_DIRECTORY)


@dataclass(frozen=True)
class ChunkConfig:
    max_characters: int = 4_000


@dataclass(frozen=True)
class GenerationConfig:
    provider: str = "ollama"
    model: str = DEFAULT_MODEL
    endpoint: str | None = None
    questions_per_chunk: int = 3
    temperature: float = 0.2
    concurrency: int = 1
    max_retries: int = 2


@dataclass(frozen=True)
class ExportConfig:
    format: str = "alpaca"
    output: str = "dataset.jsonl"
    parts: bool = False  # a folder of part files, each written by a task, in place of one file that the driver writes


@dataclass(frozen=True)
class CacheConfig:
    enabled: bool = True
    directory: str = CACHE_DIRECTORY


@dataclass(frozen=True)
class BuildConfig:
    repository: str = "."
    include: str = "docs"
    prompt_file: str | None = None
    discovery: DiscoveryConfig = field(default_factory=DiscoveryConfig)
    chunking: ChunkConfig = field(default_factory=ChunkConfig)
    generation: GenerationConfig = field(default_factory=GenerationConfig)
    export: ExportConfig = field(default_factory=ExportConfig)
    cache: CacheConfig = field(default_factory=CacheConfig)

    def check(self) -> None:
        if self.include != "docs":
            raise ConfigError(f"include {self.include!r} is not supported; only docs is")
        for name, value in (("max_characters", self.chunking.max_characters), ("questions_per_chunk", self.generation.questions_per_chunk), ("concurrency", self.generation.concurrency)):
            if value <= 0:
                raise ConfigError(f"{name} is {value}; it takes 1 at least")
        _check_model(self.generation.model, self.generation.temperature)


@dataclass(frozen=True)
class VerifierConfig:
    provider: str = "ollama"
    model: str = DEFAULT_MODEL
    endpoint: str | None = None
    temperature: float = 0.0
    concurrency: int = 1
    max_retries: int = 2


@dataclass(frozen=True)
class VerificationConfig:
    dataset: str = "dataset.jsonl"
    build_manifest: str = "manifest.json"
    repository: str = "."
    output: str = "verification.jsonl"
    prompt_file: str | None = None
    verifier: VerifierConfig = field(default_factory=VerifierConfig)
    cache: CacheConfig = field(default_factory=CacheConfig)
    parts: bool = False  # as in ExportConfig

    def check(self) -> None:
        if self.verifier.concurrency <= 0:
            raise ConfigError(f"concurrency is {self.verifier.concurrency}; it takes 1 at least")
        _check_model(self.verifier.model, self.verifier.temperature)


def _check_model(model: str, temperature: float) -> None:
    if not model.strip():
        raise ConfigError("model must not be blank")
    if not math.isfinite(temperature):
        raise ConfigError("temperature must be finite")


def to_json(config: Any) -> dict[str, Any]:
    """As manifests record it; an unset prompt_file and parts are left out, other unset options are null."""
    raw = dataclasses.asdict(config)
    for holder in (raw, raw.get("export", {})):
        if not holder.get("parts", True):
            del holder["parts"]
    raw.get("discovery", {}).pop("excluded_names", None)
    if raw.get("prompt_file", 0) is None:
        del raw["prompt_file"]
    return raw


def build_config_from_json(raw: dict[str, Any]) -> BuildConfig:
    """The build settings of a manifest; unknown fields are ignored."""

    def make(kind: type, values: dict[str, Any]) -> Any:
        known = {f.name for f in dataclasses.fields(kind)}
        return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})

    parts = {"discovery": DiscoveryConfig, "chunking": ChunkConfig, "generation": GenerationConfig, "export": ExportConfig, "cache": CacheConfig}
    return make(BuildConfig, raw | {k: make(kind, raw[k]) for k, kind in parts.items() if k in raw})
