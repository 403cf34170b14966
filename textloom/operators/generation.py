"""Text generation by an external client: models in turn, retries with waits, a shared rate, final errors.

Each task drives its rows through the same states: a model is tried up to ``retries`` times; between
tries the task waits, longer each time, and at least as long as a rate limit asks for; then the next
model of the queue has its turn. Errors of authorisation and quota end it at once. The client is made by
a function without arguments, once a task; it is called with a model and messages and returns text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .context import ERROR_KINDS, STATUS_KINDS

FINAL = ("auth", "quota")


@dataclass(frozen=True)
class Policy:
    """How a task goes on. ``rate``: calls a second of the whole job, shared by ``tasks``; null: no limit.

    ``jitter``: the share by which waits differ, drawn from a hash of row, model and try, so that reruns wait
    alike. ``give_up``: after a final error the task's remaining rows are not tried either.
    """

    models: tuple[str, ...]
    retries: int = 3
    tasks: int = 8
    rate: float | None = None
    jitter: float = 0.2
    give_up: bool = True


def kind_of(error: Exception) -> str:
    """An exception's kind, as ``context.error_kind`` tells it: by status, else by the exception's name, else by its text."""
    if (found := STATUS_KINDS.get(getattr(error, "status_code", None))) is not None:
        return found
    name, text = type(error).__name__.lower(), str(error).lower()
    for kind in ("timeout", "connection"):
        if kind in name:
            return kind
    return next((kind for kind, words in ERROR_KINDS if any(w in text for w in words)), "other")


def wait_before(attempt: int, error: Exception, jitter: float = 0.0) -> float:
    """Seconds before the try after ``attempt`` (from 0), as ``context.retry_wait`` has them; jitter from -1 to 1 times the policy's share."""
    import re

    own = 2.0 * 2.0**attempt * (1.0 + jitter)
    if kind_of(error) == "rate_limit" and (asked := re.search(r"(?:try again in|retry after)\s*(\d+\.?\d*)\s*s", str(error).lower())):
        return max(own, float(asked[1]) + 1.0)
    return own


class Pace:
    """Calls of a task no closer than its share of the rate allows."""

    def __init__(self, gap: float, clock: Callable, sleep: Callable):
        self.gap, self.clock, self.sleep, self.next = gap, clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.next is not None and now < self.next:
            self.sleep(self.next - now)
            now = self.next
        self.next = now + self.gap


def attempt_all(client: Callable, key: str, messages: list, policy: Policy, pace: Pace, sleep: Callable) -> tuple[str | None, str | None, int, float, str | None]:
    """(text, model, tries, seconds waited between tries, error kind): the text of the first model that gives one, or the last error's kind."""
    import zlib

    tries, waited, kind = 0, 0.0, None
    for model in policy.models:
        for attempt in range(policy.retries):
            pace.wait()
            tries += 1
            try:
                text = (client(model, messages) or "").strip()
                if not text:
                    raise ValueError("empty response")
                return text, model, tries, waited, None
            except Exception as error:  # noqa: BLE001 - a client may raise anything; its kind decides
                kind = kind_of(error)
                if kind in FINAL:
                    return None, model, tries, waited, kind
                if attempt < policy.retries - 1:
                    draw = zlib.crc32(f"{key}|{model}|{attempt}".encode()) / 2**31 - 1.0
                    seconds = wait_before(attempt, error, policy.jitter * draw)
                    waited += seconds
                    sleep(seconds)
    return None, None, tries, waited, kind


def complete(df: DataFrame, key: str, messages: str, make_client: Callable[[], Callable], policy: Policy, sleep: Callable | None = None, clock: Callable | None = None) -> DataFrame:
    """(key, text, model, tries, waited, error) for every row of (key, messages array of (role, content)).

    text is null on failure, and error says of what kind; with ``give_up``, rows that follow a final error in
    their task have its kind and no tries. A row without messages is not tried and has neither text nor
    error. Rows are dealt over ``policy.tasks`` tasks, which is what the rate is shared among. A task that is
    run again calls again: write the result before it is read twice.
    """
    kind = df.schema[key].dataType.simpleString()
    gap = policy.tasks / policy.rate if policy.rate else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        nap, now = sleep or time.sleep, clock or time.monotonic
        client, pace, over = make_client(), Pace(gap, now, nap), None
        for b in batches:
            out = []
            for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = (None, None, 0, 0.0, over if m else None) if over or not m else attempt_all(client, str(k), m, policy, pace, nap)
                out.append(got)
                if policy.give_up and got[4] in FINAL:
                    over = got[4]
            columns = list(zip(*out)) if out else [()] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["key", "text", "model", "tries", "waited", "error"])

    rows = df.select(key, messages).repartition(policy.tasks)
    return rows.mapInArrow(run, f"key {kind}, text string, model string, tries int, waited double, error string").withColumnRenamed("key", key)
