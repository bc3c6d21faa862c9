"""The model interface, the one plug-in point, and its two HTTP clients."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Any, Protocol

from tessera.config import DEFAULT_MODEL, PROVIDERS
from tessera.errors import ApiError, ConfigError, InvalidJson, MissingCompletion, ModelError, TransportError, UnexpectedSchema
from tessera.functions.text import py_excerpt, py_retry_delay
from tessera.operators.completions import json_loads


class ModelClient(Protocol):
    def complete(self, prompt: str, model: str, temperature: float, schema: dict[str, Any]) -> str:
        """The model's answer to a prompt, which should be JSON of the schema."""
        ...


#: Opened once in each task; must pickle.
ClientFactory = Callable[[], ModelClient]


class HttpClient:
    """timeout: seconds until a call counts as failed, so that no task waits for ever on a silent server."""

    def __init__(self, endpoint: str, timeout: float = 600.0):
        self.endpoint, self.timeout = endpoint.rstrip("/"), timeout

    def _post(self, path: str, body: dict[str, Any], headers: dict[str, str] | None = None) -> Any:
        request = urllib.request.Request(self.endpoint + path, json.dumps(body).encode(), {"Content-Type": "application/json"} | (headers or {}))
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as response:
                text = response.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            raise ApiError(e.code, e.read().decode("utf-8", "replace")) from None
        except (OSError, ValueError) as e:
            raise TransportError(f"{type(e).__name__}: {e}", isinstance(e, OSError)) from None
        try:
            return json_loads(text)
        except ValueError as e:
            raise InvalidJson(f"the API's answer is malformed ({e}): {py_excerpt(text)}") from e


class OllamaClient(HttpClient):
    def complete(self, prompt: str, model: str, temperature: float, schema: dict[str, Any]) -> str:
        answer = self._post("/api/generate", {"model": model, "prompt": prompt, "stream": False, "format": schema, "options": {"temperature": temperature}})
        if type(answer) is not dict or type(answer.get("response")) is not str:
            raise UnexpectedSchema(f"no response in {py_excerpt(str(answer))}")
        return answer["response"]


class OpenAiCompatibleClient(HttpClient):
    def __init__(self, endpoint: str, api_key: str | None = None, timeout: float = 600.0):
        super().__init__(endpoint, timeout)
        self.api_key = api_key

    def complete(self, prompt: str, model: str, temperature: float, schema: dict[str, Any]) -> str:
        form = {"type": "json_schema", "json_schema": {"name": "structured_response", "strict": True, "schema": schema}}
        body = {"model": model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature, "response_format": form}
        answer = self._post("/chat/completions", body, {"Authorization": f"Bearer {self.api_key}"} if self.api_key else None)
        choices = answer.get("choices") if type(answer) is dict else None
        if type(choices) is not list:
            raise UnexpectedSchema(f"no choices in {py_excerpt(str(answer))}")
        if not choices:
            raise MissingCompletion("the API answered without a completion")
        try:
            content = choices[0]["message"]["content"]
        except (KeyError, TypeError):
            content = None
        if type(content) is not str:
            raise UnexpectedSchema(f"no content in {py_excerpt(str(answer))}")
        return content


def resolve_api_key(file: str | None, variable: str) -> str | None:
    """The key, trimmed: from the file if one is given, which must not be empty, else from the environment; never stored."""
    if file is not None:
        try:
            with open(file, encoding="utf-8") as f:
                key = f.read().strip()
        except OSError as e:
            raise ConfigError(f"cannot read the API key file: {e}") from e
        if not key:
            raise ConfigError("the API key file is empty")
        return key
    return os.environ.get(variable, "").strip() or None


def resolve_provider(provider: str, model: str | None, endpoint: str | None, api_key_file: str | None = None, api_key_env: str = "OPENAI_API_KEY") -> tuple[str, str | None, ClientFactory]:
    """(model, endpoint as given, client factory)."""
    where = endpoint or PROVIDERS[provider]
    if provider == "ollama":
        return model or DEFAULT_MODEL, endpoint, lambda: OllamaClient(where)
    key = resolve_api_key(api_key_file, api_key_env)
    if not model:
        raise ConfigError("this provider needs a model")
    return model, endpoint, lambda: OpenAiCompatibleClient(where, key)


def with_retries(call: Callable[[], Any], max_retries: int, on_retry: Callable[[int, ModelError], None] | None = None, sleep: Callable[[float], None] = time.sleep) -> Any:
    """call(), again after retryable failures, max_retries times more at most."""
    attempt = 0
    while True:
        try:
            return call()
        except ModelError as e:
            if not e.retryable or attempt >= max_retries:
                raise
            attempt += 1
            if on_retry:
                on_retry(attempt, e)
            sleep(py_retry_delay(attempt))
