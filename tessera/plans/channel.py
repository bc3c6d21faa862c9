"""What the tasks of a running stage and the driver tell one another: who may call the model now, how far chunks are, and that there is no use in going on.

Each thread of a task that calls a model has a connection to the driver. It asks before each call and gives notice after it, so that no more than a
number of calls run at once in all tasks together, those of the earliest requests first; a connection that breaks gives back what it held. A leave to call holds for
some milliseconds of short calls, one after another, so that these do not each wait for the driver. Events come in as they
happen and go to the reporter. An error that no retry mends ends the stage: nobody may call any more, who still has leave is told, and its jobs are cancelled.
"""

from __future__ import annotations

import asyncio
import heapq
import itertools
import json
import secrets
import socket
import threading
import time
import uuid
from typing import Any

from pyspark.sql import SparkSession

from tessera.errors import ModelError, from_record, to_record
from tessera.progress import Event, Reporter, silent

#: Seconds after which a thread asks again for leave to call, however short its calls are.
LEAVE = 0.02


class Stopped(Exception):
    """The stage has failed elsewhere; nothing more is to be done."""


class Line:
    """A thread's connection to the driver."""

    def __init__(self, address: tuple[str, int], secret: str):
        self.socket = socket.create_connection(address, timeout=60)
        self.socket.settimeout(None)
        self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_KEEPALIVE, 1)
        self.socket.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)  # else a message waits until the one before is acknowledged
        self.until: float | None = None  # how long the leave to call holds, if there is one
        self.replies = self.socket.makefile("r", encoding="utf-8")
        self.socket.sendall(f"{secret}\n".encode())

    def _send(self, **message: Any) -> None:
        self.socket.sendall((json.dumps(message) + "\n").encode())

    def _told(self) -> bool:
        """Whether there is word from the driver, which comes unasked only when the stage has ended."""
        try:
            self.socket.recv(1, socket.MSG_PEEK | socket.MSG_DONTWAIT)
        except BlockingIOError:
            return False
        return True

    def begin(self, order: int) -> None:
        """Waits until a call may be made; no wait while the leave for an earlier one holds."""
        if self.until is not None and time.monotonic() < self.until and not self._told():
            return
        self.rest()
        self._send(op="begin", order=order)
        if self.replies.readline().strip() != "go":
            raise Stopped
        self.until = time.monotonic() + LEAVE

    def end(self) -> None:
        """After a call: the leave is given back if its time is over; else the next call follows at once, or rest()."""
        if self.until is not None and time.monotonic() >= self.until:
            self.rest()

    def rest(self) -> None:
        """Gives back the leave to call: there is nothing to call for just now."""
        if self.until is not None:
            self.until = None
            self._send(op="end")

    def tell(self, kind: str, details: dict[str, Any]) -> None:
        self._send(op="event", kind=kind, details=details)

    def fail(self, error: ModelError, about: dict[str, Any]) -> None:
        self.until = None
        self._send(op="fail", error=to_record(error), about=about)

    def close(self) -> None:
        self.replies.close()
        self.socket.close()


class Channel:
    """The driver's end, open for the length of a with block. error: what ended the stage (its about: what the model was asked about); finished: the indices of the events that say so."""

    def __init__(self, spark: SparkSession, most: int, report: Reporter = silent):
        self.context, self.free, self.report = spark.sparkContext, most, report
        self.secret, self.tag = secrets.token_hex(16), f"stage-{uuid.uuid4().hex}"
        self.error: Exception | None = None
        self.finished: set[int] = set()
        self.waiting: list[tuple[int, int, asyncio.Future]] = []
        self.calling: set[asyncio.StreamWriter] = set()
        self.numbers = itertools.count()
        self.loop = asyncio.new_event_loop()
        host = self.context.getConf().get("spark.driver.host", "localhost")
        self.server = self.loop.run_until_complete(asyncio.start_server(self._serve, self.context.getConf().get("spark.driver.bindAddress", host), 0, limit=1 << 24, backlog=1024))
        self.address = (host, self.server.sockets[0].getsockname()[1])
        self.thread = threading.Thread(target=self.loop.run_forever, daemon=True)

    def __enter__(self) -> Channel:
        self.thread.start()
        self.context.addJobTag(self.tag)
        return self

    def __exit__(self, *raised: Any) -> None:
        self.context.removeJobTag(self.tag)
        self.loop.call_soon_threadsafe(self.loop.stop)
        self.thread.join()
        self.loop.run_until_complete(self._close())
        self.loop.close()

    async def _close(self) -> None:
        self.server.close()
        open_ = asyncio.all_tasks() - {asyncio.current_task()}
        for task in open_:
            task.cancel()
        await asyncio.gather(*open_, return_exceptions=True)
        await self.loop.shutdown_default_executor()

    def _next(self) -> None:
        while self.waiting and (self.error or self.free):
            *_, turn = heapq.heappop(self.waiting)
            if not turn.done():
                self.free -= not self.error
                turn.set_result(not self.error)

    def _end(self, error: Exception) -> None:
        if self.error is None:
            self.error = error
            for writer in self.calling:
                writer.write(b"stop\n")
            self.loop.run_in_executor(None, self.context.cancelJobsWithTag, self.tag)

    async def _serve(self, reader: asyncio.StreamReader, writer: asyncio.StreamWriter) -> None:
        holds = False
        try:
            if (await reader.readline()).strip() != self.secret.encode():
                return
            while line := await reader.readline():
                message = json.loads(line)
                op = message["op"]
                if op == "begin":
                    turn = self.loop.create_future()
                    heapq.heappush(self.waiting, (message["order"], next(self.numbers), turn))
                    self._next()
                    holds = await turn
                    if holds and self.error:  # the stage has ended between
                        self.free, holds = self.free + 1, False
                    if holds:
                        self.calling.add(writer)
                    writer.write(b"go\n" if holds else b"stop\n")
                    await writer.drain()
                elif op == "event":
                    if message["kind"].endswith("_finished"):
                        self.finished.add(message["details"]["index"])
                    try:
                        self.report(Event(message["kind"], message["details"]))
                    except Exception as e:  # a reporter that raises ends the run, as it does elsewhere
                        self._end(e)
                elif op in ("end", "fail"):
                    if op == "fail":
                        error = from_record(message["error"])
                        error.about = message["about"]
                        self._end(error)
                    self.free += holds
                    holds = False
                    self.calling.discard(writer)
                    self._next()
        except (OSError, asyncio.IncompleteReadError):
            pass
        finally:
            self.free += holds
            self.calling.discard(writer)
            self._next()
            writer.close()
