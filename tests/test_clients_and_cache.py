import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tessera.config import GenerationConfig, VerifierConfig
from tessera.errors import ApiError, ConfigError, InvalidJson, MissingCompletion, TransportError
from tessera.operators.cache import cache_directory, generation_key, verification_key
from tessera.operators.clients import OllamaClient, OpenAiCompatibleClient, resolve_api_key, resolve_provider, with_retries


@pytest.fixture
def server():
    """Answers each POST with the next of .answers and notes what was asked."""
    seen, answers = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            seen.append((self.path, dict(self.headers), json.loads(body)))
            status, text = answers.pop(0)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    http.seen, http.answers, http.url = seen, answers, f"http://127.0.0.1:{http.server_port}"
    yield http
    http.shutdown()


def test_ollama_wire(server):
    server.answers.append((200, json.dumps({"response": "hi"})))
    assert OllamaClient(server.url + "/").complete("p", "m", 0.2, {"type": "object"}) == "hi"
    path, _, body = server.seen[0]
    assert path == "/api/generate" and body == {"model": "m", "prompt": "p", "stream": False, "format": {"type": "object"}, "options": {"temperature": 0.2}}


def test_openai_wire(server):
    server.answers.append((200, json.dumps({"choices": [{"message": {"content": "hi"}}]})))
    assert OpenAiCompatibleClient(server.url + "/v1", "key").complete("p", "m", 0.0, {}) == "hi"
    path, headers, body = server.seen[0]
    assert path == "/v1/chat/completions" and headers["Authorization"] == "Bearer key" and body["messages"] == [{"role": "user", "content": "p"}] and body["response_format"]["json_schema"]["strict"] is True


def test_errors(server):
    client = OpenAiCompatibleClient(server.url)
    for status, text, error, retryable in ((429, "slow", ApiError, True), (401, "no", ApiError, False), (200, "{", InvalidJson, True), (200, '{"choices":[]}', MissingCompletion, True)):
        server.answers.append((status, text))
        with pytest.raises(error) as e:
            client.complete("p", "m", 0, {})
        assert e.value.retryable is retryable
    with pytest.raises(TransportError):
        OllamaClient("http://127.0.0.1:1", timeout=2).complete("p", "m", 0, {})


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise ApiError(503, "")
        return "done"

    assert with_retries(call, 2, sleep=waits.append) == "done" and waits == [0.5, 1.0]
    for errors, n in ((ApiError(503, ""), 3), (ApiError(400, ""), 1)):
        calls.clear()

        def fail():
            calls.append(1)
            raise errors

        with pytest.raises(ApiError):
            with_retries(fail, 2, sleep=waits.append)
        assert len(calls) == n


def test_api_key(tmp_path, monkeypatch):
    (tmp_path / "k").write_text(" secret \n")
    (tmp_path / "e").write_text(" \n")
    monkeypatch.setenv("K", " env ")
    assert resolve_api_key(str(tmp_path / "k"), "K") == "secret" and resolve_api_key(None, "K") == "env" and resolve_api_key(None, "NONE_SUCH") is None
    for name in ("e", "none"):
        with pytest.raises(ConfigError):
            resolve_api_key(str(tmp_path / name), "K")


def test_providers():
    assert resolve_provider("ollama", None, None)[0] == "llama3.2"
    with pytest.raises(ConfigError):
        resolve_provider("open_ai_compatible", None, None)


def test_cache_directory():
    assert cache_directory("/r", ".x") == "/r/.x" and cache_directory("/r", "/x", verify=True) == "/x/verify"


def test_keys(spark):
    row = spark.createDataFrame([("c", "i", "q", "a")], "chunk_id string, id string, question string, answer string")
    key = lambda c: row.select(c.alias("k")).first().k
    base = GenerationConfig()
    same, prompt, model, temperature = (key(generation_key(g, t)) for g, t in ((GenerationConfig(concurrency=9, max_retries=0), "t"), (base, "u"), (GenerationConfig(model="x"), "t"), (GenerationConfig(temperature=0.3), "t")))
    assert key(generation_key(base, "t")) == same and len({same, prompt, model, temperature}) == 4
    assert key(verification_key(VerifierConfig(), "t")) != key(verification_key(VerifierConfig(endpoint="e"), "t"))
    assert row.select(F.length(generation_key(base, "t")).alias("n")).first().n == 64
