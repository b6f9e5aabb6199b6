"""Stateful stream operators with value and map state and event-time timers.

A key's rows of a micro-batch come in frames.  A single frame is sorted where it
is; several are sorted one by one, put into map state in parts, and merged part
by part, so a key's batch is never in memory as a whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

#: Rows of a stored part of a run, and of an output frame.
PART_ROWS, OUT_ROWS = 1024, 8192
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Row = tuple[int, int, bool]


class InOrder(StatefulProcessor):
    """Hands a key's rows of a micro-batch (us, event_id, good) to ``step`` in order of time, then of id."""

    #: Names and types of what ``step`` gives for each row.
    columns: tuple[str, ...] = ()

    def init(self, handle: object) -> None:
        self.handle = handle
        self.spill = handle.getMapState("spill", "run int, part int", "us array<bigint>, event_id array<bigint>, good array<boolean>")

    @staticmethod
    def _sorted(frame: pd.DataFrame) -> list[Row]:
        """Without a frame's own sort: most keys have few rows, and a call of pandas costs more than they do."""
        us, ids, good = (frame[c].to_numpy() for c in ("us", "event_id", "good"))
        order = np.lexsort((ids, us))
        return list(zip(us[order].tolist(), ids[order].tolist(), good[order].tolist(), strict=True))

    def _store(self, run: int, rows: list[Row]) -> int:
        parts = range(0, len(rows), PART_ROWS)
        for part, at in enumerate(parts):
            self.spill.updateValue((run, part), tuple(map(list, zip(*rows[at : at + PART_ROWS], strict=True))))
        return len(parts)

    def _read(self, run: int, parts: int) -> Iterator[Row]:
        for part in range(parts):
            columns = [list(c) for c in self.spill.getValue((run, part))]
            self.spill.removeKey((run, part))
            yield from zip(*columns, strict=True)

    def ordered(self, frames: Iterator[pd.DataFrame]) -> Iterator[Row]:
        held: list[Row] = []
        runs: list[int] = []
        for frame in frames:
            if held:
                runs.append(self._store(len(runs), held))
            held = self._sorted(frame)
        yield from heapq.merge(held, *(self._read(k, n) for k, n in enumerate(runs)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        self.begin()
        found = (out for row in self.ordered(rows) for out in self.step(*row))
        while block := list(islice(found, OUT_ROWS)):
            yield self.frame(key, block)
        self.end(timerValues)

    def frame(self, key: tuple, block: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(self.columns, ([key[0]] * len(block), *map(list, zip(*block, strict=True))), strict=True)))

    def no_timers(self) -> None:
        for held in [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]:
            self.handle.deleteTimer(held)

    def wake_at(self, ms: int, timerValues: object, fresh: bool = False) -> None:
        """One timer a key: at ``ms``, or as soon as the watermark is past it.  A ``fresh`` key has none yet: it is not asked for them."""
        if not fresh:
            self.no_timers()
        self.handle.registerTimer(max(int(ms), timerValues.getCurrentWatermarkInMs() + 1))

    def begin(self) -> None:
        raise NotImplementedError

    def step(self, us: int, event_id: int, good: bool) -> Iterator[tuple]:
        raise NotImplementedError

    def end(self, timerValues: object) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        return iter(())

    def close(self) -> None:
        pass


class TokenBucket(InOrder):
    """Each event takes a token; a bucket that had time to fill up is like a new one, so its state goes then."""

    columns = ("user_id", "event_id", "allowed")

    def __init__(self, rate: float, burst: float) -> None:
        self.rate, self.burst = rate, burst

    def init(self, handle: object) -> None:
        super().init(handle)
        self.bucket = handle.getValueState("bucket", "tokens double, last bigint")

    def begin(self) -> None:
        held = self.bucket.get()
        self.fresh = held is None
        self.tokens, self.last = (self.burst, None) if held is None else held

    def step(self, us: int, event_id: int, good: bool) -> Iterator[tuple]:
        if self.last is not None:
            self.tokens = min(self.burst, self.tokens + max(0, us - self.last) / 1e6 * self.rate)
        self.last = us if self.last is None else max(us, self.last)
        allowed = self.tokens >= 1
        self.tokens -= 1 if allowed else 0
        yield int(event_id), bool(allowed)

    def end(self, timerValues: object) -> None:
        if self.last is not None:
            self.bucket.update((float(self.tokens), int(self.last)))
            self.wake_at(self.last // 1000 + int(self.burst / self.rate * 1000) + 1, timerValues, self.fresh)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        return iter(())


class CircuitBreaker(InOrder):
    """CLOSED; OPEN after failures in a row; HALF_OPEN once the wait is over.  A closed circuit without failures holds no state."""

    columns = ("event_type", "event_id", "state")

    def __init__(self, failures: int, open_seconds: float) -> None:
        self.failures, self.wait = failures, open_seconds * 1e6

    def init(self, handle: object) -> None:
        super().init(handle)
        self.circuit = handle.getValueState("circuit", "now string, bad bigint, since bigint")

    def begin(self) -> None:
        self.now, self.bad, self.since = self.circuit.get() or ("CLOSED", 0, 0)

    def step(self, us: int, event_id: int, good: bool) -> Iterator[tuple]:
        if self.now == "OPEN" and us - self.since >= self.wait:
            self.now = "HALF_OPEN"
        if self.now != "OPEN":
            if good:
                self.now, self.bad = "CLOSED", 0
            else:
                self.bad += 1
                if self.now == "HALF_OPEN" or self.bad >= self.failures:
                    self.now, self.since = "OPEN", us
        yield int(event_id), self.now

    def end(self, timerValues: object) -> None:
        if self.now == "CLOSED" and not self.bad:
            self.circuit.clear()
        else:
            self.circuit.update((self.now, int(self.bad), int(self.since)))


class TokenBuffer(InOrder):
    """Events leave in groups of ``least``, or ``wait_ms`` after the first: when the next one comes, or when the watermark has passed that time."""

    columns = ("user_id", "event_ids")

    def __init__(self, least: int, wait_ms: int) -> None:
        self.least, self.wait_ms = least, wait_ms

    def init(self, handle: object) -> None:
        super().init(handle)
        self.buffer = handle.getListState("buffer", "event_id bigint")
        self.start = handle.getValueState("start", "us bigint")

    def begin(self) -> None:
        held = self.start.get()
        self.fresh = held is None
        self.first = None if held is None else held[0]
        self.ids = [int(r[0]) for r in self.buffer.get()] if self.first is not None else []  # fewer than ``least``

    def step(self, us: int, event_id: int, good: bool) -> Iterator[tuple]:
        if not self.ids:
            self.first = us
        self.ids.append(int(event_id))
        if len(self.ids) >= self.least or us - self.first >= self.wait_ms * 1000:
            yield (self.ids,)
            self.ids = []

    def end(self, timerValues: object) -> None:
        if self.ids:
            self.buffer.put([(i,) for i in self.ids])
            self.start.update((int(self.first),))
            self.wake_at(self.first // 1000 + self.wait_ms, timerValues, self.fresh)
        elif not self.fresh:
            self.no_timers()  # a key without state has no timer
            self.buffer.clear()
            self.start.clear()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.begin()
        # A timer that an older checkpoint left without state may come before its time.
        if self.ids and expiredTimerInfo.getExpiryTimeInMs() < self.first // 1000 + self.wait_ms:
            return
        if not self.fresh:
            self.buffer.clear()
            self.start.clear()
        if self.ids:
            yield self.frame(key, [(self.ids,)])


def run(timed: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """``processor`` over ``timed(key, event_id, us, good, at)``, whose watermark is on ``at``.

    Its state is kept in RocksDB; the session is set to it, as streams that
    already have a checkpoint stay with the store that this names.
    """
    timed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return timed.select(key, "event_id", "us", "good", "at").groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")
