"""Model calls as columns. The default backend replays recorded replies; nothing here reaches a network."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .balance import balanced

# Replies worth another try, and the waits between tries.
RETRY_CODES = (429, 500, 502, 503, 504)
RETRY_PHRASES = ("resource_exhausted", "rate_limit", "quota", "temporarily unavailable", "overloaded", "try again")
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 5, 2.0, 60.0


def is_retryable(kind: Column, code: Column, message: Column) -> Column:
    """Server, connection, timeout and system errors; client errors by code or phrase."""
    phrase = F.lit(False)
    for p in RETRY_PHRASES:
        phrase = phrase | F.contains(F.lower(message), F.lit(p))
    return F.coalesce(kind.isin("server", "connection", "timeout", "os") | ((kind == "client") & (code.isin(*RETRY_CODES) | phrase)), F.lit(False))


def longest_wait(attempt: Column) -> Column:
    """The upper end of the wait after the n-th failed try, n from 1."""
    return F.least(F.lit(FIRST_WAIT) * F.pow(F.lit(2.0), attempt - 1), F.lit(LONGEST_WAIT))


def waits(attempts: int = ATTEMPTS, seed: int | None = None) -> list[float]:
    """A jittered series of waits: each uniform between 0 and its upper end, never beyond the longest."""
    r = random.Random(seed)
    return [r.uniform(0, min(FIRST_WAIT * 2**i, LONGEST_WAIT)) for i in range(attempts - 1)]


def kind_of(error: Exception) -> tuple[str, int | None]:
    """(kind, code) of an error: by its ``code`` if it carries one, else by its type."""
    code = getattr(error, "code", None)
    if isinstance(code, int):
        return ("server" if code >= 500 else "client"), code
    kinds = ((TimeoutError, "timeout"), (ConnectionError, "connection"), (OSError, "os"))
    return next((k for t, k in kinds if isinstance(error, t)), "other"), None


def worth_another_try(error: Exception) -> bool:
    """``is_retryable`` for one error."""
    kind, code = kind_of(error)
    if kind == "client":
        return code in RETRY_CODES or any(p in str(error).lower() for p in RETRY_PHRASES)
    return kind != "other"


class Replay:
    """Recorded replies: a table of (sample_id, stage, raw_response, latency_ms). A missing reply is an error."""

    def __init__(self, recorded: DataFrame):
        self.recorded = recorded

    def __call__(self, requests: DataFrame, stage: str) -> DataFrame:
        """Adds (raw_response, latency_ms, error) to requests."""
        r = self.recorded.where(F.col("stage") == stage).drop("stage")
        got = requests.join(r, "sample_id", "left")
        return got.withColumn("error", F.when(F.col("raw_response").isNull(), F.lit("no recorded reply")))


class Budget:
    """How many more rows may fail in a task; shared by its threads."""

    def __init__(self, most: int | None):
        self.left, self.lock = most, Lock()

    def spent(self) -> bool:
        return self.left is not None and self.left <= 0

    def charge(self) -> None:
        with self.lock:
            if self.left is not None:
                self.left -= 1


class Calls:
    """A user's function (prompt, try from 1 -> (reply, seconds)), tried again where the error is worth it.

    At most ``at_once`` calls of a task are in flight, and replies come back in the order of the rows. Time is taken inside the
    successful try, so waits don't count as latency. A row that fails keeps its error and doesn't disturb the others; so
    does a row without a prompt, which is never called. Once ``most_failures`` rows of a task have failed, calls in flight end
    and the rest keep an error that says so. The waits' jitter depends on the prompt. ``cost`` names a column, such as
    a duration, by which requests are first dealt over ``parts`` partitions of equal cost, the longest first.

    Tries are counted by row, never in a worker, so a task that runs again makes the same calls.
    """

    def __init__(
        self, function: Callable[[str, int], tuple[str, float]], attempts: int = ATTEMPTS, sleep: Callable[[float], None] | None = None, at_once: int = 8,
        most_failures: int | None = None, cost: str | None = None, by: tuple[str, ...] = ("sample_id",), parts: int | None = None,
    ):
        if at_once < 1:
            raise ValueError("at least one call at once")
        self.function, self.attempts, self.sleep, self.at_once = function, attempts, sleep, at_once
        self.most_failures, self.cost, self.by, self.parts = most_failures, cost, by, parts

    def __call__(self, requests: DataFrame, stage: str) -> DataFrame:
        function, attempts, sleep, at_once, most_failures = self.function, self.attempts, self.sleep, self.at_once, self.most_failures

        def one(prompt: str | None, budget: Budget) -> tuple:
            if not isinstance(prompt, str):
                return None, None, "no prompt"
            if budget.spent():
                return None, None, "not called: too many failures"
            reply = (None, None, "never tried")
            for k, wait in enumerate([*waits(attempts, crc32(prompt.encode("utf-8", "surrogatepass"))), None], 1):
                try:
                    text, seconds = function(prompt, k)
                    return text, int(round(seconds * 1000)), None
                except Exception as e:  # noqa: BLE001  the row carries what went wrong
                    reply = (None, None, f"{type(e).__name__}: {e}")
                    if not worth_another_try(e):
                        break
                    if sleep and wait is not None:
                        sleep(wait)
            budget.charge()
            return reply

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            budget = Budget(most_failures)
            with ThreadPoolExecutor(at_once) as pool:
                for pdf in batches:
                    out = list(pool.map(lambda p: one(p, budget), pdf["prompt"]))
                    yield pdf.assign(raw_response=[o[0] for o in out], latency_ms=pd.array([o[1] for o in out], "Int64"), error=[o[2] for o in out])

        if self.cost:
            requests = balanced(requests, self.cost, list(self.by), self.parts)
        fields = ", ".join(f"{n} {t}" for n, t in requests.dtypes)
        return requests.mapInPandas(run, f"{fields}, raw_response string, latency_ms long, error string")
