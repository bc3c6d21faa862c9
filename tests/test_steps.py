"""What the two dataflows have on disk while they write their output. The channel is stood in for, no port is opened."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.config import BuildConfig, CacheConfig, ExportConfig, GenerationConfig, VerificationConfig, VerifierConfig
from tessera.plans import build, model_stage, verify
from tessera.plans.files import Written
from tessera.queries import Echo, Judge


@pytest.fixture
def alone(monkeypatch):
    """Model stages without their channel."""

    class Line:
        def __init__(self, address, secret):
            pass

        def begin(self, order):
            pass

        end = rest = close = lambda self: None

    class Channel:
        address, secret, error = ("", 0), "", None

        def __init__(self, *a):
            self.finished = set()

        def __enter__(self):
            return self

        def __exit__(self, *raised):
            pass

    monkeypatch.setattr(model_stage, "Line", Line)
    monkeypatch.setattr(model_stage, "Channel", Channel)


@pytest.fixture
def seen(monkeypatch):
    """By dataflow, the folders of tables that it has made, and those that were there still when it wrote its lines."""
    made, found = [], {}
    first = Written.__init__

    def noted(self, spark):
        first(self, spark)
        made.append(self.root.removeprefix("file://"))

    monkeypatch.setattr(Written, "__init__", noted)
    for module in (build, verify):

        def write(*a, write=module.write_lines, name=module.__name__):
            found[name] = [os.path.isdir(root) for root in made]
            made.clear()
            write(*a)

        monkeypatch.setattr(module, "write_lines", write)
    return found


def test_only_what_is_written_is_left(spark, tmp_path, alone, seen):
    root = tmp_path / "repo"
    root.mkdir()
    for k in range(5):
        (root / f"{k}.md").write_text(f"# Title {k}\n\nText of {k}.\n")
    out = str(tmp_path / "dataset.jsonl")
    settings = BuildConfig(str(root), export=ExportConfig(output=out), generation=GenerationConfig(model="echo", questions_per_chunk=1), cache=CacheConfig(False))
    made = build.build_dataset(spark, settings, Echo)
    assert made.model_calls == 5 and len(open(out).readlines()) == 5
    done = verify.verify_dataset(spark, VerificationConfig(out, made.manifest_path, str(root), str(tmp_path / "report.jsonl"), verifier=VerifierConfig(model="judge"), cache=CacheConfig(False)), Judge)
    assert done.stats["total_items"] == 5 and done.stats["unverifiable_items"] == 0 and len(open(done.output).readlines()) == 5
    assert {name: sum(left) for name, left in seen.items()} == {build.__name__: 1, verify.__name__: 1}
    assert all(len(left) > 1 for left in seen.values())


def test_files_are_read_by_several_tasks(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"{k}.md").write_text(f"text {k}")
    items = spark.range(80).select(F.struct(F.concat((F.col("id") % 40).cast("string"), F.lit(".md")).alias("path")).alias("source"))
    read = verify.referenced_documents(items, str(tmp_path), 100).select("*", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.path, r.text) for r in read) == sorted((f"{k}.md", f"text {k}") for k in range(40))
    assert len({r.task for r in read}) == 4
