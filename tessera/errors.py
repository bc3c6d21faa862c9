"""What can go wrong, by stage."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors of the engine."""


class ConfigError(EngineError, ValueError):
    """A setting that no run can work with; raised before any work."""


class DiscoveryError(EngineError):
    pass


class ChunkError(EngineError, ValueError):
    pass


class PromptError(EngineError):
    pass


class CacheError(EngineError):
    """A cache entry that cannot be read or written; a damaged entry is an error, not a miss."""


class ExportError(EngineError):
    pass


class NoDocuments(EngineError):
    pass


class NoChunks(EngineError):
    pass


class DatasetError(EngineError):
    """A dataset or manifest that cannot be read; line is the number of the line at fault."""

    def __init__(self, message: str, line: int | None = None):
        super().__init__(message if line is None else f"line {line}: {message}")
        self.line = line


class ModelError(EngineError):
    """A failed model call. Retryable: HTTP 429 and 5xx, timeouts and refused connections, and answers that are not as asked for."""

    retryable = False


class ApiError(ModelError):
    def __init__(self, status: int, body: str):
        super().__init__(f"the model API answered {status}: {body}")
        self.status, self.body = status, body
        self.retryable = status == 429 or 500 <= status <= 599

    def __reduce__(self):
        return ApiError, (self.status, self.body)


class TransportError(ModelError):
    def __init__(self, message: str, retryable: bool = True):
        super().__init__(message)
        self.retryable = retryable

    def __reduce__(self):
        return TransportError, (str(self), self.retryable)


class InvalidJson(ModelError):
    retryable = True


class UnexpectedSchema(ModelError):
    retryable = True


class MissingCompletion(ModelError):
    retryable = True


class StageFailed(EngineError):
    """A run that ended because the model failed for good; what it was asked about is in the message, cause is the model's error."""

    def __init__(self, about: str, cause: ModelError):
        super().__init__(f"no answer about {about}: {cause}")
        self.cause = cause


def to_record(error: ModelError) -> dict:
    """A model error as plain values, for another process."""
    return {"kind": type(error).__name__, "message": str(error), "retryable": error.retryable} | ({"status": error.status, "body": error.body} if isinstance(error, ApiError) else {})


def from_record(record: dict) -> ModelError:
    kind = {c.__name__: c for c in (ModelError, ApiError, TransportError, InvalidJson, UnexpectedSchema, MissingCompletion)}.get(record["kind"], ModelError)
    if kind is ApiError:
        return ApiError(record["status"], record["body"])
    return TransportError(record["message"], record["retryable"]) if kind is TransportError else kind(record["message"])
