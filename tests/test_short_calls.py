"""Many short calls: what the driver is asked for, what it may still stop, how often answers are synced, and how prompts and answers move. Lines are pairs of sockets here, no port is opened."""

import asyncio
import os
import socket
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tessera.errors import ApiError, CacheError
from tessera.operators.answers import AnswerLog, AnswerStore, read_log
from tessera.plans import channel as ch
from tessera.plans.channel import Channel, Line, Stopped
from tessera.plans.model_stage import dealt_out


@pytest.fixture
def opened(spark, monkeypatch):
    """opened(most): a channel, and a function that makes lines to it."""

    class Listening:
        sockets = [socket.socketpair()[0]]

        def close(self):
            pass

    async def listen(*a, **k):
        return Listening()

    monkeypatch.setattr(asyncio, "start_server", listen)
    monkeypatch.setattr(socket.socket, "getsockname", lambda s: ("", 0))
    monkeypatch.setattr(socket.socket, "setsockopt", lambda *a: None)

    def make(most, report=lambda e: None):
        channel, held = Channel(spark, most, report), []

        def line():
            near, far = socket.socketpair()

            async def serve():
                held.append(asyncio.current_task())  # the loop itself holds tasks weakly
                await channel._serve(*await asyncio.open_unix_connection(sock=far))

            asyncio.run_coroutine_threadsafe(serve(), channel.loop)
            with monkeypatch.context() as m:
                m.setattr(socket, "create_connection", lambda *a, **k: near)
                return Line(channel.address, channel.secret)

        return channel, line

    return make


def counted(line):
    """The messages that a line sends from now on."""
    sent, send = [], line._send
    line._send = lambda **message: (sent.append(message["op"]), send(**message))
    return sent


def test_short_calls_share_a_leave(opened, monkeypatch):
    monkeypatch.setattr(ch, "LEAVE", 5)
    channel, line = opened(1)
    with channel:
        one = line()
        sent = counted(one)
        for k in range(100):
            one.begin(k)
            one.end()
        assert sent == ["begin"] and channel.free == 0
        one.rest()
        two = line()
        two.begin(0)  # would wait for ever if the leave were held still
        assert sent == ["begin", "end"] and channel.free == 0
        one.close(), two.close()


def test_a_leave_ends(opened, monkeypatch):
    monkeypatch.setattr(ch, "LEAVE", 0.05)
    channel, line = opened(1)
    with channel:
        one, two = line(), line()
        sent = counted(one)
        one.begin(3)
        threading.Timer(0.01, lambda: (time.sleep(0.1), one.end())).start()  # a call longer than the leave
        two.begin(4)
        assert sent == ["begin", "end"]
        two.close()
        one.begin(5)
        one.end()
        time.sleep(0.06)
        one.begin(6)  # its time is over: asked for again
        assert sent == ["begin", "end", "begin", "end", "begin"]
        one.close()


def test_who_has_leave_is_told_of_the_end(opened, monkeypatch):
    monkeypatch.setattr(ch, "LEAVE", 60)
    channel, line = opened(2)
    with channel:
        one, two = line(), line()
        one.begin(0), two.begin(1)
        one.begin(2)
        two.fail(ApiError(401, "no"), {"path": "a.md"})
        until = time.monotonic() + 10
        with pytest.raises(Stopped):
            while time.monotonic() < until:
                one.begin(3)
        with pytest.raises(Stopped):
            two.begin(4)
        one.close(), two.close()
    assert channel.error.status == 401


@pytest.mark.parametrize("seconds", [0.0, 0.004, 0.03])
def test_no_more_calls_at_once_than_allowed(opened, seconds):
    channel, line = opened(3)
    lock, now, most, made = threading.Lock(), 0, 0, 0
    with channel:
        lines = [line() for _ in range(8)]

        def work(own):
            nonlocal now, most, made
            for k in range(25):
                own.begin(k)
                with lock:
                    now, made = now + 1, made + 1
                    most = max(most, now)
                time.sleep(seconds)
                with lock:
                    now -= 1
                own.end()
            own.rest()

        with ThreadPoolExecutor(8) as pool:
            list(pool.map(work, lines))
        for own in lines:
            own.close()
    assert made == 200 and most <= 3 and (most == 3 or not seconds)


def test_answers_are_synced_together(tmp_path, monkeypatch):
    synced, fsync = [], os.fsync

    def slow(file):
        time.sleep(0.02)
        fsync(file)
        synced.append(os.path.getsize(next(tmp_path.glob("*.log"))))

    monkeypatch.setattr(os, "fsync", slow)
    log = AnswerLog(str(tmp_path))
    for k in range(200):
        log.write({"key": f"k{k}", "answer": "1", "answered_at": "t", "retries": 0})
    log.settle()
    path = next(tmp_path.glob("*.log"))
    assert 1 <= len(synced) < 50 and synced[-1] == path.stat().st_size
    log.append({"key": "last", "answer": "1", "answered_at": "t", "retries": 0})
    assert synced[-1] == path.stat().st_size
    log.write({"key": "after", "answer": "1", "answered_at": "t", "retries": 0})
    log.close()
    assert synced[-1] == path.stat().st_size and [e["key"] for e in read_log(str(path))] == [*(f"k{k}" for k in range(200)), "last", "after"]


def test_a_sync_that_fails_is_an_error(tmp_path, monkeypatch):
    def fails(file):
        raise OSError("disk")

    monkeypatch.setattr(os, "fsync", fails)
    log = AnswerLog(str(tmp_path))
    with pytest.raises(CacheError, match="disk"):
        log.append({"key": "k", "answer": "1", "answered_at": "t", "retries": 0})
    log.close()


@pytest.mark.parametrize("asked", [range(0, 60), range(0, 60, 2), [3, 58]])
def test_prompts_move_once_if_most_are_asked_for(spark, asked):
    prompts = spark.range(60).select(F.col("id").alias("ord"), F.concat(F.lit("p"), "id").alias("prompt"), F.lit("{}").alias("about"))
    missing = spark.createDataFrame([(f"k{k}", k) for k in asked], "key string, ord long")
    want = [(f"k{k}", k, f"p{k}", "{}") for k in asked]
    for most in (True, False):
        dealt = dealt_out(missing, prompts, 3, most)
        parts = dealt.withColumn("part", F.spark_partition_id()).collect()
        assert sorted(tuple(r)[:4] for r in parts) == sorted(want)
        ordered = [r["ord"] for r in sorted(parts, key=lambda r: r["part"])]  # rows of a task stay as they come
        assert ordered == sorted(asked)
    assert dealt_out(missing, prompts, 3, True)._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 1
    assert len({r["part"] for r in dealt_out(missing, prompts, 3, True).withColumn("part", F.spark_partition_id()).collect()}) == min(3, len(want))


def test_a_small_table_of_answers_is_written_by_several_tasks(spark, tmp_path):
    keys = spark.range(300).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.lit("1").alias("answer"), F.lit("t").alias("answered_at"), F.lit(0).alias("retries"))
    store = AnswerStore(str(tmp_path))
    store.add(keys)
    names = [n for d in os.listdir(store.segments) if d.startswith("bucket=") for n in os.listdir(store.bucket(d.removeprefix("bucket="))) if n.startswith("part-")]
    assert len({n.split("-")[1] for n in names}) == 4 and len(names) == len({r.key[:2] for r in keys.collect()})
    assert store.lookup(keys.select("key")).count() == 300
