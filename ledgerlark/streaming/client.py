"""Calls of a slow and unsure service from a task: a bounded pool, deadlines that end the work, retries with back-off.

A call runs in a process of the pool. When its deadline is over the process is killed, and another one takes its place, so
that nothing of a hanging call is left. Failures that may pass are tried again, each time after a longer pause, while
other calls go on. Outcomes keep the order of the values.
"""

from __future__ import annotations

import heapq
import multiprocessing
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from multiprocessing.connection import Connection, wait

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Outcome:
    """result, or error as text; attempts: how many calls it took; seconds: from the first call to the outcome."""

    result: str | None
    error: str | None
    attempts: int
    seconds: float = field(default=0.0, compare=False)


def may_pass(error: Exception) -> bool:
    """Whether a failure is one of the line or of time, and not of the value."""
    return isinstance(error, ConnectionError | TimeoutError | InterruptedError)


@dataclass(frozen=True)
class Client:
    """work(value) -> result; pool: calls at once in a task; seconds: the deadline of a call (None: none); attempts: calls
    of a value at most; pause: seconds before the second call, then factor times the last pause, at most longest."""

    work: Callable[[str], str]
    pool: int = 4
    seconds: float | None = 120.0
    attempts: int = 3
    pause: float = 0.5
    factor: float = 2.0
    longest: float = 30.0
    again: Callable[[Exception], bool] = may_pass

    def outcomes(self, values: Sequence[str]) -> list[Outcome]:
        """The outcome of each value, in order."""
        done: list[Outcome | None] = [None] * len(values)
        ready = [(0.0, i, 1) for i in range(len(values))]  # when, which, attempt
        begun: dict[int, float] = {}
        slots: list[_Slot] = []
        try:
            while ready or any(s.busy for s in slots):
                now = time.monotonic()
                for slot in [s for s in slots if not s.busy] + [None] * (min(self.pool, len(values)) - len(slots)):
                    if not ready or ready[0][0] > now:
                        break
                    _, i, attempt = heapq.heappop(ready)
                    if slot is None:
                        slots.append(slot := _Slot(self.work))
                    begun.setdefault(i, now)
                    slot.start(i, attempt, values[i], None if self.seconds is None else now + self.seconds)
                for slot, result, error in self._ended(slots, ready, now):
                    i, attempt = slot.busy
                    slot.busy = None
                    if error is not None and attempt < self.attempts and self.again(error):
                        pause = min(self.pause * self.factor ** (attempt - 1), self.longest)
                        heapq.heappush(ready, (time.monotonic() + pause, i, attempt + 1))
                    else:
                        done[i] = Outcome(result, None if error is None else str(error), attempt, time.monotonic() - begun[i])
        finally:
            for slot in slots:
                slot.kill()
        return done

    def _ended(self, slots: list[_Slot], ready: list, now: float) -> Iterator[tuple[_Slot, str | None, Exception | None]]:
        """Calls that have ended by now: answered, died, or killed at their deadline."""
        busy = [s for s in slots if s.busy]
        ends = [s.until for s in busy if s.until is not None] + ([ready[0][0]] if ready and len(busy) < min(self.pool, len(slots) + 1) else [])
        answered = wait([s.line for s in busy], max(0.0, min(ends) - now) if ends else None) if busy else time.sleep(max(0.0, min(ends) - now)) or []
        for slot in busy:
            if slot.line in answered:
                try:
                    yield slot, *slot.line.recv()
                except EOFError:
                    slot.renew()
                    yield slot, None, ConnectionError("the call's process has ended")
            elif slot.until is not None and time.monotonic() >= slot.until:
                slot.renew()
                yield slot, None, TimeoutError(f"no result within {self.seconds:g} seconds")


def _serve(line: Connection, work: Callable[[str], str]) -> None:
    while True:
        try:
            value = line.recv()
        except EOFError:
            return
        try:
            answer = work(value), None
        except Exception as e:  # any failure of a call is its outcome
            answer = None, e
        try:
            line.send(answer)
        except Exception:  # an error that cannot be sent is sent as text
            line.send((None, RuntimeError(str(answer[1]))))


class _Slot:
    """A process of the pool; busy: (which value, attempt) of its call."""

    def __init__(self, work: Callable[[str], str]):
        self.work, self.busy, self.until = work, None, None
        self._begin()

    def _begin(self) -> None:
        context = multiprocessing.get_context("fork")
        self.line, theirs = context.Pipe()
        self.process = context.Process(target=_serve, args=(theirs, self.work), daemon=True)
        self.process.start()
        theirs.close()

    def start(self, i: int, attempt: int, value: str, until: float | None) -> None:
        self.busy, self.until = (i, attempt), until
        self.line.send(value)

    def kill(self) -> None:
        self.process.kill()
        self.process.join()
        self.line.close()

    def renew(self) -> None:
        self.kill()
        self._begin()


def called(df: DataFrame, column: str, client: Client, result: str = "result", error: str = "error", attempts: str = "attempts") -> DataFrame:
    """df with the outcome of each row's value; a null value is not sent and has no outcome. The rows' order stays. A task
    holds one batch of rows and the pool's calls."""
    schema = df.withColumns({result: F.lit(None).cast("string"), error: F.lit(None).cast("string"), attempts: F.lit(None).cast("int")}).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sent = batch[column].notna().to_numpy()
            outcomes = iter(client.outcomes(batch[column][sent].tolist()))
            each = [next(outcomes) if s else Outcome(None, None, 0) for s in sent]
            yield batch.assign(**{result: [o.result for o in each], error: [o.error for o in each], attempts: pd.array([o.attempts for o in each], "int32")})[schema.names]

    return df.mapInPandas(run, schema)
