"""The model stage: how many calls run, what survives, what is told while it runs, and how its answers are stored."""

import json
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from tessera.errors import ApiError, CacheError, ModelError, TransportError, UnexpectedSchema, from_record, to_record
from tessera.operators import answers as store
from tessera.operators.answers import AnswerLog, AnswerStore, read_log
from tessera.operators.order import numbered
from tessera.plans import model_stage
from tessera.plans.channel import Channel, Line, Stopped
from tessera.plans.files import Written
from tessera.plans.model_stage import Call, ask

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def model(log, seconds=0.0, refuses=None, kills=None, fails=None):
    """A factory for a stand-in model that notes each call's prompt, beginning and end in log; it refuses one prompt, or all, for good, fails one once, or kills its
    worker once at another."""

    class Model:
        def complete(self, prompt, name, temperature, schema):
            import json
            import os
            import signal
            import time
            import uuid

            from tessera.errors import ApiError

            began, once = time.time(), os.path.join(log, "once")
            if prompt in (kills, fails) and not os.path.exists(once):
                open(once, "w").close()
                if prompt == kills:
                    time.sleep(1.5)
                    os.kill(os.getpid(), signal.SIGKILL)
                raise ApiError(503, "busy")
            time.sleep(seconds)
            with open(os.path.join(log, f"{uuid.uuid4().hex}.call"), "w") as f:
                f.write(json.dumps([prompt, began, time.time()]))
            if refuses in (prompt, "all"):
                raise ApiError(401, "no")
            return json.dumps(prompt.upper())

    return Model


def calls(log):
    return [json.loads(p.read_text()) for p in log.glob("*.call")]


def requests(spark, n, repeated=0):
    rows = spark.range(n + repeated).select((F.col("id") % n).alias("p"), F.col("id").alias("ord"))
    return rows.select(F.sha2(F.col("p").cast("string"), 256).alias("key"), F.concat(F.lit("p"), "p").alias("prompt"), "ord", F.concat(F.lit("at "), "ord").alias("place"))


def call(factory, **more):
    return Call(factory, "m", 0.0, {}, json.loads, **more)


def folder(tmp_path, name="log"):
    (tmp_path / name).mkdir()
    return tmp_path / name


@pytest.fixture
def keep(spark):
    made = Written(spark)
    yield made
    made.close()


def peak(found):
    return max(sum(a <= t < b for _, a, b in found) for _, t, _ in found)


@pytest.mark.parametrize("task_requests", [1000, 5])
def test_calls_at_once_do_not_hang_on_tasks(spark, tmp_path, keep, monkeypatch, task_requests):
    monkeypatch.setattr(model_stage, "TASK_REQUESTS", task_requests)
    log = folder(tmp_path)
    found = ask(requests(spark, 40, 6), call(model(str(log), 0.15), concurrency=6), None, keep)
    assert found.rows.select("answer").distinct().count() == 40 == found.rows.count() == len(calls(log)) and found.counts() == (40, 0)
    assert peak(calls(log)) == 6
    if task_requests == 5:
        assert found.rows.select(F.spark_partition_id()).distinct().count() > 1 or found.rows.rdd.getNumPartitions() > 1


def test_one_call_at_a_time_in_order(spark, tmp_path, keep):
    log = folder(tmp_path)
    ask(requests(spark, 12), call(model(str(log), 0.02)), None, keep)
    assert [p for p, *_ in sorted(calls(log), key=lambda c: c[1])] == [f"p{k}" for k in range(12)] and peak(calls(log)) == 1


def test_events_come_while_the_stage_runs(spark, tmp_path, keep):
    log, events = folder(tmp_path), []
    found = ask(requests(spark, 6, 2), call(model(str(log), 0.4, fails="p2"), concurrency=2, finished=lambda answer: {"length": len(answer)}), None, keep, lambda e: events.append((time.time(), e)), ("place",))
    ended = max(e for *_, e in calls(log))
    assert sum(t < ended - 0.5 for t, _ in events) >= 6  # long before the last call
    by_index = {k: [(e.kind, e.details.get("length")) for _, e in events if e.details["index"] == k] for k in range(6)}
    assert by_index[0] == [("chunk_started", None), ("chunk_finished", 2)] and [k for k, _ in by_index[2]] == ["chunk_started", "retry_scheduled", "chunk_finished"]
    begun = next(e for _, e in events if e.details["index"] == 0)
    assert begun.details == {"index": 0, "total": 8, "source": "model", "place": "at 0"} and found.told == set(range(6)) and found.counts() == (7, 1)


def test_a_reporter_that_raises_ends_the_stage(spark, tmp_path, keep):
    def report(event):
        raise RuntimeError("no screen")

    with pytest.raises(RuntimeError, match="no screen"):
        ask(requests(spark, 50), call(model(str(folder(tmp_path)), 0.2)), None, keep, report)


def test_a_warm_run_reads_what_it_asks_for(spark, tmp_path, keep):
    log, directory = folder(tmp_path), str(tmp_path / "cache")
    ask(requests(spark, 600), call(model(str(log)), concurrency=8), directory, keep)
    assert len(calls(log)) == 600 and len(os.listdir(f"{directory}/segments")) > 200 and not os.listdir(f"{directory}/logs")
    one = requests(spark, 600).where("ord = 77")
    key = one.first()["key"]
    found = AnswerStore(directory).lookup(one.select("key"))
    assert [os.path.dirname(f) for f in found.inputFiles()] == [f"file://{directory}/segments/bucket={key[:2]}"] and found.count() == 1
    again = ask(requests(spark, 603), call(model(str(log))), directory, keep)
    assert again.counts() == (3, 0) and again.rows.where("cached").count() == 600 and sorted(p for p, *_ in calls(log))[-1] == "p99"
    assert {r.answer for r in again.rows.collect()} == {f'"P{k}"' for k in range(603)}


def test_segments_are_merged(spark, tmp_path, keep):
    kept = AnswerStore(str(tmp_path))
    for k in range(store.MOST_SEGMENTS + 2):
        kept.add(spark.createDataFrame([(f"ab{k}", f"{k}", "t", 0), ("ab", '"x"', "t", 0)], store.ENTRY))
    assert len([n for n in os.listdir(kept.bucket("ab")) if n.endswith(".parquet")]) <= store.MOST_SEGMENTS
    found = kept.lookup(spark.createDataFrame([(f"ab{k}",) for k in ["", *range(12)]], "key string")).collect()
    assert sorted(r.answer for r in found) == sorted(['"x"', *(str(k) for k in range(store.MOST_SEGMENTS + 2))])


def test_logs_of_a_run_that_died(spark, tmp_path, keep):
    kept, keys = AnswerStore(str(tmp_path)), spark.createDataFrame([("aa",), ("bb",), ("cc",)], "key string")
    assert kept.lookup(keys) is None
    log = AnswerLog(str(tmp_path / "logs" / "run" / "0"))
    for key in ("aa", "bb"):
        log.append({"key": key, "answer": '["é"]', "answered_at": "t", "retries": 0})
    log.close()
    path = next((tmp_path / "logs").glob("*/*/*.log"))
    with open(path, "ab") as f:
        f.write(b"0123 {torn")
    assert [e["key"] for e in read_log(str(path))] == ["aa", "bb"] and sorted(AnswerLog(str(path.parent)).earlier()) == ["aa", "bb"]
    assert sorted(r.key for r in kept.lookup(keys).collect()) == ["aa", "bb"]
    kept.recover(spark)
    assert path.exists()  # it may still be written
    os.utime(path, (0, 0))
    kept.recover(spark)
    assert not path.exists() and sorted((r.key, r.answer) for r in kept.lookup(keys).collect()) == [("aa", '["é"]'), ("bb", '["é"]')]


def test_damaged_entries_are_errors(spark, tmp_path, keep):
    kept = AnswerStore(str(tmp_path / "a"))
    kept.add(spark.createDataFrame([(r.key, "{", "t", 0) for r in requests(spark, 1).collect()], store.ENTRY))
    with pytest.raises(CacheError, match="cache entry"):
        ask(requests(spark, 2), call(model(str(folder(tmp_path)))), str(tmp_path / "a"), keep)
    log = AnswerLog(str(tmp_path / "b" / "logs" / "r" / "0"))
    log.append({"key": "aa", "answer": "1", "answered_at": "t", "retries": 0})
    path = next((tmp_path / "b").glob("logs/*/*/*.log"))
    path.write_bytes(path.read_bytes().replace(b'"1"', b'"2"'))
    with pytest.raises(CacheError, match="damaged"):
        list(read_log(str(path)))
    with pytest.raises(CacheError, match="cache entry"):
        ask(requests(spark, 2), call(model(str(tmp_path / "log"))), str(tmp_path / "b"), keep)


def test_lines_wait_for_their_turn(spark):
    events = []
    with Channel(spark, 1, events.append) as channel:
        one, two, stranger = Line(channel.address, channel.secret), Line(channel.address, channel.secret), Line(channel.address, "x")
        with pytest.raises((Stopped, OSError)):
            stranger.begin(0)
        one.begin(5)
        one.close()  # a lost task gives back what it held
        two.begin(6)
        two.tell("chunk_finished", {"index": 3})
        two.fail(ApiError(401, "no"), {"path": "a.md"})
        with pytest.raises(Stopped):
            two.begin(7)
        two.close()
    assert channel.error.status == 401 and channel.error.about == {"path": "a.md"} and channel.finished == {3} and events[0].kind == "chunk_finished"


def test_errors_as_records():
    for error in (ApiError(503, "b"), TransportError("t", False), UnexpectedSchema("u"), ModelError("m")):
        back = from_record(json.loads(json.dumps(to_record(error))))
        assert type(back) is type(error) and str(back) == str(error) and back.retryable == error.retryable


def test_numbers_without_a_single_task(spark, keep):
    frame = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("y").alias("y"))
    found = numbered(frame.unionByName(frame.where("x < 5")), [F.col("x")], "n", keep)
    rows = sorted((r.n, r.x) for r in found.collect())
    assert [n for n, _ in rows] == list(range(1005)) and [x for _, x in rows] == sorted([*range(1000), *range(5)])
    assert numbered(frame.limit(0), [F.col("x")], "n", keep).count() == 0


ALONE = """
import json, os, sys
sys.path[:0] = [{root!r}, {tests!r}]
os.environ["PYTHONPATH"] = os.pathsep.join(sys.path[:2])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2,4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import test_model_stage as t
from pathlib import Path
from tessera.plans import model_stage
from tessera.plans.files import Written
model_stage.TASK_REQUESTS = 10
keep, here = Written(spark), Path({here!r})
try:
    found = t.ask(t.requests(spark, 30), t.call(t.model(str(here / "log"), **{model!r}), **{call!r}), str(here / "cache"), keep)
    print("RESULT", json.dumps([found.rows.count(), *found.counts()]))
except Exception as e:
    print("RESULT", json.dumps(type(e).__name__))
again = t.ask(t.requests(spark, 30), t.call(t.model(str(t.folder(here, "second")))), str(here / "cache"), keep)
print("RESULT", json.dumps([again.rows.count(), *again.counts()]))
"""


def alone(here, model, call):
    """A run in a Spark that runs lost tasks again, four times in all."""
    folder(here)
    code = ALONE.format(root=ROOT, tests=os.path.join(ROOT, "tests"), here=str(here), model=model, call=call)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    found = [json.loads(line.removeprefix("RESULT ")) for line in done.stdout.splitlines() if line.startswith("RESULT ")]
    assert len(found) == 2, done.stdout[-2000:] + done.stderr[-2000:]
    return found


def test_a_refusal_ends_the_stage_at_once(tmp_path):
    first, again = alone(tmp_path, {"seconds": 0.3, "refuses": "all"}, {"concurrency": 3})
    assert first == "ApiError" and len(calls(tmp_path / "log")) <= 3 and again == [30, 30, 0]


def test_what_was_finished_before_a_refusal_stays(tmp_path):
    first, again = alone(tmp_path, {"seconds": 0.1, "refuses": "p5"}, {"concurrency": 2})
    made = calls(tmp_path / "log")
    assert first == "ApiError" and [p for p, *_ in made].count("p5") == 1 and len(made) < 15 and again[0] == 30 and 30 - len(made) <= again[1] - 1 <= 30 - len(made) + 2


def test_a_lost_task_repeats_no_finished_call(tmp_path):
    first, again = alone(tmp_path, {"seconds": 0.02, "kills": "p7"}, {"concurrency": 2})
    made = [p for p, *_ in calls(tmp_path / "log")]
    assert first == [30, 30, 0] and sorted(made) == sorted(f"p{k}" for k in range(30)) and again == [30, 0, 0]
