"""A sliding-window log by client: as a batch over sorted rows, as a stream, and in a process."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICROS = 1_000_000
#: Clients above which a process looks for idle ones.
SWEEP = 4096
# Fixed values: (requests, seconds).
ASK_BUDGET, EXPLAIN_BUDGET = (60, 300), (15, 3600)
_OUT = "key string, ts long, allowed boolean, retry_after long"


def admit(log: deque, now: int, limit: int, window: int) -> tuple[bool, int]:
    """Whether a request at ``now`` is let in, and the seconds to wait if not. Times in microseconds.

    ``log`` holds the times of requests let in; those before the window's start go. Requests that are
    turned away don't count. No limit (0 or less) lets all in.
    """
    if limit <= 0:
        return True, 0
    while log and log[0] < now - window:
        log.popleft()
    if len(log) < limit:
        log.append(now)
        return True, 0
    return False, max(1, (log[0] + window - now) // MICROS + 1)


def limited(requests: DataFrame, limit: int, window_seconds: float) -> DataFrame:
    """(key, ts, allowed, retry_after) of each of ``requests`` (key, ts in microseconds).

    Rows are sorted by key and time within a task and read once; what is held is one client's log, of
    ``limit`` times at most, however many requests a client has.
    """
    window = int(window_seconds * MICROS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, log = None, deque()
        for b in batches:
            out = []
            for k, ts in zip(b["key"], b["ts"], strict=True):
                if k != key:
                    key, log = k, deque()
                out.append(admit(log, int(ts), limit, window))
            yield b.assign(allowed=[a for a, _ in out], retry_after=[r for _, r in out])

    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("long").alias("ts"))
    return rows.repartition("key").sortWithinPartitions("key", "ts").mapInPandas(run, _OUT)


def limited_stream(requests: DataFrame, limit: int, window_seconds: float, forget: bool = True) -> DataFrame:
    """The same over a stream of (key, ts). A client's log is its state; a client that is idle for a window is forgotten.

    Forgetting runs by processing time, for which Spark goes on with batches without data; a replay
    that is to end by itself (``trigger(availableNow=True)``) needs ``forget=False``.
    """
    window = int(window_seconds * MICROS)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = deque(state.get[0] if state.exists else ())
        times = sorted(int(t) for b in batches for t in b["ts"])
        out = [(key[0], t, *admit(log, t, limit, window)) for t in times]
        state.update((list(log),))
        if forget:
            state.setTimeoutDuration(max(1, window // 1000))
        yield pd.DataFrame(out, columns=["key", "ts", "allowed", "retry_after"])

    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("long").alias("ts"))
    return rows.groupBy("key").applyInPandasWithState(run, _OUT, "log array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)


class RateLimiter:
    """The same for one process; threads may share one."""

    def __init__(self, limit: int, window_seconds: float, clock: Callable[[], float] = time.monotonic):
        self.limit, self.window, self.clock, self.logs = limit, int(window_seconds * MICROS), clock, {}
        self.lock = threading.Lock()

    def check(self, key: str) -> tuple[bool, int]:
        with self.lock:
            now = int(self.clock() * MICROS)
            out = admit(self.logs.setdefault(key, deque()), now, self.limit, self.window)
            if len(self.logs) > SWEEP:
                self.logs = {k: v for k, v in self.logs.items() if v and v[-1] >= now - self.window}
            return out
