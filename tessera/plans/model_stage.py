"""The stage that calls a model: cached answers are joined, the others are asked for in tasks, each stored as soon as it is there."""

from __future__ import annotations

import contextlib
import datetime
import json
import queue
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import CacheError, ModelError
from tessera.functions.text import py_retry_delay
from tessera.operators.answers import AnswerStore
from tessera.operators.clients import ClientFactory, ModelClient, with_retries
from tessera.plans.channel import Channel, Line, Stopped
from tessera.progress import Event, Reporter, silent

ANSWERS = "key string, answer string, answered_at string, cached boolean, retries int"
#: Requests for which a task is worth starting; answers that a task hands on at a time.
TASK_REQUESTS, HANDED_ON = 256, 64


def now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).isoformat().replace("+00:00", "Z")


@dataclass(frozen=True)
class Call:
    """How a model is asked. parse: of a completion, its answer as plain values; kind: what its events are about (chunk, item); finished: what the last event tells of an answer."""

    factory: ClientFactory
    model: str
    temperature: float
    schema: dict[str, Any]
    parse: Callable[[str], Any]
    concurrency: int = 1
    max_retries: int = 2
    kind: str = "chunk"
    finished: Callable[[Any], dict[str, Any]] = field(default=lambda answer: {})


@dataclass(frozen=True)
class Answers:
    """rows: ANSWERS of each distinct key; told: the indices of requests whose events have been reported."""

    rows: DataFrame
    told: set[int]

    def counts(self) -> tuple[int, int]:
        """(model calls, retries), from the answers themselves: a call that a lost task had finished counts once, one that it had not counts not at all."""
        row = self.rows.where("NOT cached").agg(F.coalesce(F.sum(F.col("retries") + 1), F.lit(0)), F.coalesce(F.sum("retries"), F.lit(0))).first()
        return row[0], row[1]


def ask(requests: DataFrame, call: Call, directory: str | None, keep: Callable[[DataFrame], DataFrame], report: Reporter = silent, about: tuple[str, ...] = ()) -> Answers:
    """The answers to requests (key, prompt, ord, and what events tell, the columns about); ord is a number of its own for each request and their order.

    Equal keys are asked once, for the first of them. What the store in directory holds is found by a join; the other keys are dealt to tasks in
    their order, and each task has a pool of threads and hands on answers in order. However many tasks there are, `concurrency` calls run at once. Keys and numbers
    are grouped and joined, prompts only follow the keys that are asked. An error that no retry mends ends the stage at once; it is raised with the columns
    about of its request as its attribute of that name.
    """
    spark = requests.sparkSession
    keys = keep(requests.groupBy("key").agg(F.min("ord").alias("ord")))
    store = AnswerStore(directory) if directory else None
    held = None
    if store:
        try:
            store.recover(spark)
            held = store.lookup(keys)
            held = keep(held) if held is not None else None
        except CacheError:
            raise
        except Exception as e:
            raise CacheError(f"a cache entry in {directory} cannot be read: {str(e).splitlines()[0][:500]}") from e
    missing = keep(keys if held is None else keys.join(held.select("key"), "key", "left_anti"))
    n = missing.count()
    told: set[int] = set()
    asked = None
    if n:
        asked, told = _ask(missing, n, requests, call, store, keep, report, about)
    cached = None if held is None else held.select("key", "answer", "answered_at", F.lit(True).alias("cached"), F.lit(0).alias("retries"))
    frames = [f for f in (cached, asked) if f is not None]
    rows = frames[0] if frames else spark.createDataFrame([], ANSWERS)
    return Answers(rows.unionByName(frames[1]) if len(frames) == 2 else rows, told)


def _ask(missing: DataFrame, n: int, requests: DataFrame, call: Call, store: AnswerStore | None, keep: Callable[[DataFrame], DataFrame], report: Reporter, about: tuple[str, ...]) -> tuple[DataFrame, set[int]]:
    spark = requests.sparkSession
    tasks = min(-(-n // TASK_REQUESTS), max(int(spark.conf.get("spark.sql.shuffle.partitions")), call.concurrency))
    at_once = min(tasks, max(1, spark.sparkContext.defaultParallelism))
    pool = -(-call.concurrency // at_once) + (tasks > 1)  # a thread more, so that no call waits for a task that has run out of requests
    total = requests.count()
    run_id, loud = uuid.uuid4().hex, report is not silent
    place = F.to_json(F.struct(*about)) if about else F.lit("{}")
    dealt = dealt_out(missing, requests.select("ord", "prompt", place.alias("about")), tasks, most=2 * n >= total)

    with Channel(spark, call.concurrency, report) as channel:
        address, secret = channel.address, channel.secret

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            log = store.log(run_id) if store else None
            before = log.earlier() if log else {}  # there is something if this task has been lost before
            todo, lines = queue.SimpleQueue(), []

            def work() -> None:
                """One thread, which takes requests until there is None, and gives back its leave to call while there are none."""
                line = client = None
                while True:
                    try:
                        job = todo.get_nowait()
                    except queue.Empty:
                        if line is not None:
                            with contextlib.suppress(OSError):  # the next request will say so
                                line.rest()
                        job = todo.get()
                    if job is None:
                        return
                    row, done = job
                    try:
                        if entry := before.get(row[0]):
                            done.set_result((row[0], entry["answer"], entry["answered_at"], False, entry["retries"]))
                            continue
                        if line is None:
                            line = Line(address, secret)
                            lines.append(line)
                        if client is None:
                            client = call.factory()
                        done.set_result(one(line, client, *row))
                    except BaseException as e:
                        done.set_exception(e)

            def one(line: Line, client: ModelClient, key: str, order: int, prompt: str, place: str) -> tuple:
                again = 0
                details = {"index": order, "source": "model"} | json.loads(place)
                if loud:
                    line.tell(f"{call.kind}_started", {"total": total} | details)

                def once() -> Any:
                    line.begin(order)
                    try:
                        answer = call.parse(client.complete(prompt, call.model, call.temperature, call.schema))
                    except ModelError as e:
                        if not e.retryable or again >= call.max_retries:
                            line.fail(e, json.loads(place))  # while the call still counts, so that no other begins
                            raise Stopped from e
                        line.rest()
                        raise
                    except BaseException:
                        line.rest()
                        raise
                    line.end()
                    return answer

                def retry(attempt: int, error: ModelError) -> None:
                    nonlocal again
                    again = attempt
                    if loud:
                        line.tell("retry_scheduled", {"index": order, "attempt": attempt, "max_retries": call.max_retries, "delay_ms": int(1000 * py_retry_delay(attempt))})

                answer = with_retries(once, call.max_retries, retry)
                entry = {"key": key, "answer": json.dumps(answer, ensure_ascii=False), "answered_at": now(), "retries": again}
                if log:
                    log.write(entry)
                if loud:
                    line.tell(f"{call.kind}_finished", details | call.finished(answer))
                return key, entry["answer"], entry["answered_at"], False, again

            def handed_on(rows: list[tuple]) -> pd.DataFrame:
                if log:
                    log.settle()
                return pd.DataFrame(rows, columns=["key", "answer", "answered_at", "cached", "retries"])

            threads = ThreadPoolExecutor(pool)
            try:
                for _ in range(pool):
                    threads.submit(work)
                with contextlib.suppress(Stopped):
                    for batch in batches:
                        rows, pending = [], deque()
                        for row in zip(batch["key"].tolist(), batch["ord"].tolist(), batch["prompt"].tolist(), batch["about"].tolist()):
                            pending.append(Future())
                            todo.put((row, pending[-1]))
                            if len(pending) > max(2 * pool, HANDED_ON):
                                rows.append(pending.popleft().result())
                            if len(rows) >= HANDED_ON:
                                yield handed_on(rows)
                                rows = []
                        rows += [p.result() for p in pending]
                        yield handed_on(rows)
            finally:
                with contextlib.suppress(queue.Empty):
                    while True:
                        todo.get_nowait()
                for _ in range(pool):
                    todo.put(None)
                threads.shutdown(wait=True)
                for line in lines:
                    line.close()
                if log:
                    log.close()

        asked = None
        try:
            asked = keep(dealt.mapInPandas(run, ANSWERS))
        except Exception:
            if channel.error is None:
                if store:
                    store.seal(spark, run_id)
                raise
    if channel.error is not None:
        if store:
            store.seal(spark, run_id)
        raise channel.error
    if store:
        store.add(asked.select("key", "answer", "answered_at", "retries"))
        store.forget(run_id)
    return asked, channel.finished


def dealt_out(missing: DataFrame, prompts: DataFrame, tasks: int, most: bool) -> DataFrame:
    """(key, ord, prompt, about) of missing (key, ord), in as many ranges of ord. If most of prompts (ord, prompt, about) are asked for, they move once, and meet their keys in their range;
    else those that are asked for are picked first."""
    columns = ["key", "ord", "prompt", "about"]
    if not most:
        return missing.join(prompts, "ord").repartitionByRange(tasks, "ord").sortWithinPartitions("ord").select(columns)
    both = missing.unionByName(prompts, allowMissingColumns=True).repartitionByRange(tasks, "ord").sortWithinPartitions("ord")
    met = both.groupBy("ord").agg(*[F.max(c).alias(c) for c in columns if c != "ord"])
    return met.where("key IS NOT NULL").sortWithinPartitions("ord").select(columns)


def report_others(places: DataFrame, answers: Answers, kind: str, total: int, report: Reporter, finished: dict[str, str]) -> None:
    """Events of the requests of which the stage told none itself, cached ones, further ones of a key, and those without a key, in order. places: key, ord and what events tell; finished:
    what the last event tells besides, by the column of places or of answers that holds it."""
    if report is silent:
        return
    joined = places.join(answers.rows.select("key", "cached", F.when(F.col("answer").startswith("["), F.expr("json_array_length(answer)")).alias("items")), "key", "left").orderBy("ord")
    for row in joined.toLocalIterator():
        if row["ord"] in answers.told:
            continue
        source = {True: "cache", False: "model", None: None}[row["cached"]]
        about = {"index": row["ord"], "source": source} | {k: v for k, v in row.asDict().items() if k not in ("key", "ord", "cached", "items", *finished.values())}
        report(Event(f"{kind}_started", {"total": total} | about))
        report(Event(f"{kind}_finished", about | {name: row[column] for name, column in finished.items()}))


def typed(answers: DataFrame, schema: str) -> DataFrame:
    return answers.withColumn("answer", F.from_json("answer", schema))
