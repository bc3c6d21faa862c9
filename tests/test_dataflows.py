import dataclasses
import json
import os
import time

import pytest

from tessera import cli
from tessera.config import BuildConfig, CacheConfig, ChunkConfig, DiscoveryConfig, ExportConfig, GenerationConfig, VerificationConfig, build_config_from_json, to_json
from tessera.errors import CacheError, ConfigError, DatasetError, ExportError, NoChunks, NoDocuments, StageFailed
from tessera.plans.files import Written
from tessera.plans.build import build_dataset, git_commit, output_paths
from tessera.plans.verify import fails_gate, source_path, verify_dataset
from tessera.sources.dataset import read_dataset, read_manifest


def client(log=None, fail_on=None, delays=None, fail_times=0):
    """A factory for a stand-in model; log: a folder in which each call leaves when it began and ended."""

    def make():
        class Fake:
            def complete(self, prompt, model, temperature, schema):
                import json
                import os
                import re
                import time
                import uuid

                from tessera.errors import ApiError, UnexpectedSchema

                began = time.time()
                source = re.search(r"<source>\n(.*)\n</source>", prompt, re.S)[1]
                for word, delay in (delays or {}).items():
                    if word in source:
                        time.sleep(delay)
                if log:
                    with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                        f.write(json.dumps([began, time.time()]))
                    if fail_times and len(os.listdir(log)) <= fail_times:
                        raise UnexpectedSchema("not yet")
                if fail_on and fail_on in source:
                    raise ApiError(401, "no")
                if "items" in schema["properties"]:
                    title = source.split("\n")[0].lstrip("# ")
                    return json.dumps({"items": [{"question": f"What is {title}?", "answer": source[:50], "tags": ["t"], "confidence": 0.5}, {"question": "The same question?", "answer": "A"}]})
                check = lambda passed: {"passed": passed, "reason": "because"}
                return json.dumps({"grounded": check(True), "self_contained": check("The same question?" not in prompt), "answer_relevant": check(True), "evidence": None})

        return Fake()

    return make


def repo(tmp_path, files):
    for path, text in files.items():
        full = tmp_path / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(text)
    return str(tmp_path)


def config(root, out, **generation):
    prompt_file = generation.pop("prompt_file", None)
    return BuildConfig(root, prompt_file=prompt_file, export=ExportConfig(output=str(out)), generation=GenerationConfig(**{"max_retries": 0} | generation))


def records(path):
    return [json.loads(line) for line in open(path, encoding="utf-8")]


def test_build_and_cache(spark, tmp_path):
    root = repo(tmp_path / "r", {"README.md": "# Intro\r\nText.\n", "b/x.md": "# X\nMore."})
    out = tmp_path / "out" / "d.jsonl"
    events = []
    first = build_dataset(spark, config(root, out), client(), events.append)
    text = out.read_text()
    assert first.model_calls == 2 and [r["instruction"] for r in records(out)] == ["What is Intro?", "The same question?", "What is X?"]
    assert first.manifest["stats"] == {"discovered_files": 2, "processed_files": 2, "skipped_files": 0, "chunks": 2, "generated_items": 3, "rejected_items": 0, "duplicate_items": 1}
    assert [e.kind for e in events][0] == "discovery_started" and [e.details["chunks"] for e in events if e.kind == "file_chunked"] == [1, 1]
    second = build_dataset(spark, config(root, out, concurrency=2), client())
    assert second.model_calls == 0 and out.read_text() == text
    meta = records(out)[0]["metadata"]
    assert meta["source"] == {"path": "README.md", "start_line": 1, "end_line": 2} and meta["tags"] == ["t"] and "tags" not in records(out)[1]["metadata"]
    manifest = read_manifest(first.manifest_path)
    assert build_config_from_json(manifest["config"]).generation == GenerationConfig(max_retries=0, concurrency=2) and manifest["prompt"]["version"] == "qa-v1"
    assert build_dataset(spark, config(root, out, model="other"), client()).model_calls == 2


def test_events_of_chunks_and_items(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    root, out, events = repo(tmp_path / "r", {"a.md": "# A\nx", "b.md": "# B\ny"}), tmp_path / "d.jsonl", []
    build_dataset(spark, config(root, out, max_retries=1), client(str(log), fail_times=1), events.append)
    told = [e for e in events if e.kind in ("chunk_started", "retry_scheduled", "chunk_finished", "validation_finished")]
    assert [e.kind for e in told] == ["chunk_started", "retry_scheduled", "chunk_finished", "chunk_started", "chunk_finished", "validation_finished"]
    assert told[0].details == {"index": 0, "total": 2, "source": "model", "path": "a.md", "start_line": 1, "end_line": 2}
    assert told[1].details == {"index": 0, "attempt": 1, "max_retries": 1, "delay_ms": 500} and told[2].details["generated_items"] == 2
    assert told[-1].details == {"accepted": 3, "rejected": 0, "duplicates": 1}
    again = []
    build_dataset(spark, config(root, out), client(), again.append)
    assert [e.details["source"] for e in again if e.kind == "chunk_finished"] == ["cache", "cache"]
    seen = []
    verify_dataset(spark, VerificationConfig(str(out), str(tmp_path / "manifest.json"), root, str(tmp_path / "v.jsonl")), client(), seen.append)
    items = [e.details for e in seen if e.kind == "item_finished"]
    assert [i["index"] for i in items] == [0, 1, 2] and {i["verdict"] for i in items} == {"accepted", "rejected"} and sum(e.kind == "item_started" for e in seen) == 3


def test_cached_answers_are_joined(spark, tmp_path):
    root, out = repo(tmp_path / "r", {f"{k}.md": f"# T{k}\nx" for k in range(5)}), tmp_path / "d.jsonl"
    build_dataset(spark, config(root, out), client())
    (tmp_path / "r" / "5.md").write_text("# T5\nnew")
    assert build_dataset(spark, config(root, out), client()).model_calls == 1
    sorted((tmp_path / "r" / ".tessera" / "segments").glob("*/*.parquet"))[0].write_bytes(b"[1")
    with pytest.raises(CacheError, match="cache entry"):
        build_dataset(spark, config(root, out), client())


def test_output_folder_and_custom_prompt(spark, tmp_path):
    root = repo(tmp_path / "r", {"a.md": "# A\ntext", "my-prompt.md": "{{path}}\n<source>\n{{chunk_text}}\n</source>"})
    out = tmp_path / "out"
    out.mkdir()
    done = build_dataset(spark, config(root, out, prompt_file="my-prompt.md"), client())
    assert sorted(os.listdir(out)) == ["dataset.jsonl", "manifest.json"] and done.manifest["prompt"]["version"] == "custom" and done.manifest["stats"]["discovered_files"] == 1
    assert output_paths("x/y.jsonl") == ("x/y.jsonl", "x/manifest.json")


def test_order_and_concurrency(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    root = repo(tmp_path / "r", {"a.md": "# S1\nx\n# S2\ny\n# S3\nz"})
    out = tmp_path / "d.jsonl"
    build_dataset(spark, config(root, out, concurrency=2), client(str(log), delays={"S1": 0.8, "S2": 0.3, "S3": 0.3}))
    assert [r["instruction"] for r in records(out)] == ["What is S1?", "The same question?", "What is S2?", "What is S3?"]
    spans = [json.loads((log / n).read_text()) for n in os.listdir(log)]
    assert max(sum(a <= t < b for a, b in spans) for t, _ in spans) <= 2


def test_retry(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    done = build_dataset(spark, config(repo(tmp_path / "r", {"a.md": "# A\nx"}), tmp_path / "d.jsonl", max_retries=1), client(str(log), fail_times=1))
    assert (done.model_calls, done.retries) == (2, 1)


def test_finished_work_survives(spark, tmp_path):
    root = repo(tmp_path / "r", {"a.md": "# One\nx", "b.md": "# Two\ny"})
    with pytest.raises(StageFailed, match="b.md:1-2.*401") as e:
        build_dataset(spark, config(root, tmp_path / "d.jsonl"), client(fail_on="Two", delays={"Two": 1.0}))
    assert e.value.cause.status == 401
    assert spark.read.parquet(os.path.join(root, ".tessera", "segments")).count() == 1
    assert build_dataset(spark, config(root, tmp_path / "d.jsonl"), client()).model_calls == 1


def test_nothing_to_do(spark, tmp_path):
    with pytest.raises(NoDocuments):
        build_dataset(spark, config(repo(tmp_path / "r", {"a.txt": "x"}), tmp_path / "d"), client())
    with pytest.raises(NoChunks):
        build_dataset(spark, config(repo(tmp_path / "s", {"a.md": " \n"}), tmp_path / "d"), client())


@pytest.mark.parametrize("bad", [dict(include="all"), dict(chunking=ChunkConfig(0)), dict(generation=GenerationConfig(questions_per_chunk=0)), dict(generation=GenerationConfig(concurrency=0)), dict(generation=GenerationConfig(model=" ")), dict(generation=GenerationConfig(temperature=float("nan")))])
def test_bad_settings(spark, tmp_path, bad):
    with pytest.raises(ConfigError):
        build_dataset(spark, BuildConfig(repository=str(tmp_path), **bad), client())


def test_verify(spark, tmp_path):
    root = repo(tmp_path / "r", {"a.md": "# A\ntext"})
    out = tmp_path / "d.jsonl"
    built = build_dataset(spark, config(root, out), client())
    v = VerificationConfig(str(out), built.manifest_path, root, str(tmp_path / "v" / "verification.jsonl"))
    before = out.read_text()
    done = verify_dataset(spark, v, client())
    assert done.stats == {"total_items": 2, "accepted_items": 1, "rejected_items": 1, "unverifiable_items": 0} and done.model_calls == 2 and out.read_text() == before
    first = records(done.output)[0]
    assert first["verdict"] == "accepted" and first["verifier"]["model"] == "llama3.2" and "evidence" not in first and first["checks"]["grounded"] == {"passed": True, "reason": "because"}
    assert verify_dataset(spark, v, client()).model_calls == 0
    assert [fails_gate(done.stats, g) for g in ("never", "rejected", "any")] == [False, True, True]
    (tmp_path / "r" / "a.md").write_text("# A\nchanged")
    changed = verify_dataset(spark, v, client())
    assert changed.stats["unverifiable_items"] == 2 and changed.model_calls == 0 and "reason" in records(changed.output)[0]
    assert [fails_gate(changed.stats, g) for g in ("never", "rejected", "any")] == [False, False, True]
    assert os.path.exists(changed.manifest_path)


def test_dataset_is_read_strictly(spark, tmp_path):
    root = repo(tmp_path / "r", {"a.md": "# A\ntext"})
    out = tmp_path / "d.jsonl"
    build_dataset(spark, config(root, out), client())
    lines = out.read_text().splitlines()
    assert [r.item_ord for r in read_dataset(spark, str(out), Written(spark)).orderBy("item_ord").collect()] == [0, 1]
    for body, line in ((lines[0] + "\n\n" + lines[1] + "\n", 2), (lines[0] + "\n{bad\n", 2), ('{"instruction":1}\n', 1)):
        out.write_text(body)
        with pytest.raises(DatasetError) as e:
            read_dataset(spark, str(out), Written(spark))
        assert e.value.line == line
    out.write_text("")
    with pytest.raises(DatasetError):
        read_dataset(spark, str(out), Written(spark))


def test_folders_of_parts(spark, tmp_path):
    root = repo(tmp_path / "r", {f"{k}.md": f"# S{k}\ntext {k}" for k in range(9)})
    out = tmp_path / "o" / "d"
    one = tmp_path / "d.jsonl"
    build_dataset(spark, config(root, one), client())
    for _ in range(2):  # a second run takes the first one's place
        done = build_dataset(spark, dataclasses.replace(config(root, out), export=ExportConfig(output=f"{out}/", parts=True)), client())
    assert out.is_dir() and done.output == str(out) and done.manifest_path == str(tmp_path / "o" / "manifest.json") and done.manifest["config"]["export"]["parts"] is True
    read = lambda path: [(r.item_ord, r.id, r.question) for r in read_dataset(spark, str(path), Written(spark)).orderBy("item_ord").collect()]
    assert read(out) == read(one) and len(read(out)) == 10
    settings = VerificationConfig(str(out), done.manifest_path, root, str(tmp_path / "v"), parts=True)
    outcome = verify_dataset(spark, settings, client())
    assert outcome.stats["total_items"] == 10 == spark.read.json(str(tmp_path / "v")).count()
    with pytest.raises(ExportError):
        build_dataset(spark, dataclasses.replace(config(root, one), export=ExportConfig(output=str(one), parts=True)), client())


def test_paths_stay_inside(tmp_path):
    root = repo(tmp_path / "r", {"a.md": "x"})
    (tmp_path / "outside.md").write_text("x")
    os.symlink(tmp_path / "outside.md", tmp_path / "r" / "link.md")
    assert source_path(root, "a.md") and not any(source_path(root, p) for p in ("../outside.md", "link.md", str(tmp_path / "outside.md"), "none.md"))


def test_command_line():
    args = cli.parser().parse_args(["build"])
    made = cli.build_config(args, "m", None)
    assert made == BuildConfig(generation=GenerationConfig(model="m"))
    args = cli.parser().parse_args(["build", "--ignore-file", "a", "--ignore-file", "b", "--no-gitignore", "--no-cache", "--max-files", "3", "--provider", "openai-compatible"])
    made = cli.build_config(args, "m", "http://e")
    assert made.discovery == DiscoveryConfig(False, ("a", "b"), 3) and made.cache == CacheConfig(False) and made.generation.provider == "open_ai_compatible"
    v = cli.verification_config(cli.parser().parse_args(["verify", "--fail-on", "any"]), "m", None)
    assert v == VerificationConfig(verifier=v.verifier) and v.verifier.temperature == 0.0
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["verify", "--fail-on", "x"])
    assert "prompt_file" not in to_json(made) and to_json(made)["discovery"]["max_files"] == 3


def test_what_the_command_line_says(spark, tmp_path, capsys, monkeypatch):
    root, out = repo(tmp_path / "r", {"a.md": "# A\ntext", "b.txt": "x"}), tmp_path / "d.jsonl"
    monkeypatch.setattr(cli, "resolve_provider", lambda *_: ("m", None, client()))
    arguments = ["--repo", root, "--out", str(out), "--max-retries", "0"]
    assert cli.main(["build", *arguments]) == 0
    said = capsys.readouterr()
    assert said.out == f"2 items from 1 chunks of 1 files in {out}\nmanifest in {tmp_path / 'manifest.json'}\n"
    assert said.err.splitlines()[2:6] == ["a.md: 1 chunks", "1 chunks to ask about, 1 at a time", "[1/1] a.md:1-2", "[1] a.md:1-2: 2 items"]
    assert cli.main(["verify", "--dataset", str(out), "--manifest", str(tmp_path / "manifest.json"), "--repo", root, "--out", str(tmp_path / "v.jsonl"), "--fail-on", "rejected"]) == 1
    said = capsys.readouterr()
    assert said.out.startswith("2 items: 1 accepted, 1 rejected, 0 unverifiable\n") and ": rejected" in said.err
    monkeypatch.setattr(cli, "resolve_provider", lambda *_: ("m", None, client(fail_on="A")))
    assert cli.main(["build", *arguments, "--no-cache"]) == 1
    assert capsys.readouterr().err.splitlines()[-1] == "error: no answer about a.md:1-2: the model API answered 401: no"


def test_git_commit(tmp_path):
    assert git_commit(str(tmp_path)) is None


def test_stream(spark, tmp_path):
    from tessera.streaming.chunks import stream_documents, write_chunks

    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([(f"{k}.md", "# A\nx\n# B\ny")], "path string, text string").write.mode("append").parquet(folder)
        write_chunks(stream_documents(spark, folder), out, str(tmp_path / "c")).awaitTermination()
        assert spark.read.parquet(out).count() == 2 * (k + 1)
        time.sleep(0.1)
