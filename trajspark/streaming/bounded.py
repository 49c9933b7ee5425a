"""Session streams with a bound on live sessions.

Sessions are dealt out to shards. A shard is the key of the state: it keeps at most ``most`` sessions, forgets the one used longest ago when another
one comes, and forgets idle ones by event-time timers. State is thus at most shards x most x length values, whatever arrives.
"""

from __future__ import annotations

import heapq
import pickle
from collections import OrderedDict
from collections.abc import Iterator
from itertools import islice
from tempfile import TemporaryFile
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from trajspark.streaming.sessions import OUTPUT, SessionState, plain_rows

KEPT = "history ARRAY<DOUBLE>, last_call LONG, last_valid DOUBLE, used LONG, ms LONG"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
READ = ("session", "seq", "ms", "call_index", "value", "valid", "reset")
#: Rows of a micro-batch that are sorted at once, and rows that are read from a sorted run or handed on at a time.
RUN, CHUNK = 1 << 18, 1 << 11


def in_order(batches: Iterator[pd.DataFrame], run: int = RUN, chunk: int = CHUNK) -> Iterator[tuple]:
    """The rows (:data:`READ`) in ``seq`` order, equal ones as they came and null last, whatever their number: runs of at least ``run`` rows
    are sorted and put aside in a file of the task, then merged."""
    def stored(part: pd.DataFrame) -> Iterator[tuple]:
        file = TemporaryFile()
        for lo in range(0, len(part), chunk):
            pickle.dump(part.iloc[lo:lo + chunk], file, protocol=pickle.HIGHEST_PROTOCOL)
        return read(file, len(part))

    def read(file, rows: int) -> Iterator[tuple]:
        with file:
            file.seek(0)
            for _ in range(0, rows, chunk):
                yield from plain(pickle.load(file))

    def plain(rows: pd.DataFrame) -> Iterator[tuple]:
        return zip(*(rows[c].tolist() for c in READ))

    def taken(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts, ignore_index=True).sort_values("seq", kind="stable")

    runs, parts, rows = [], [], 0
    for part in batches:
        parts.append(part[list(READ)])
        rows += len(part)
        if rows >= run:
            runs.append(stored(taken(parts)))
            parts, rows = [], 0
    if parts:
        last = taken(parts)
        runs.append(stored(last) if runs else (row for lo in range(0, rows, chunk) for row in plain(last.iloc[lo:lo + chunk])))
    return heapq.merge(*runs, key=lambda r: (0, r[1]) if r[1] == r[1] else (1, 0)) if len(runs) > 1 else iter(*runs) if runs else iter(())


class Shard(StatefulProcessor):
    """The sessions of one shard, by time of use; only those that a micro-batch touches are written back."""

    def __init__(self, length: int, most: int, ttl_ms: int):
        self.length, self.most, self.ttl_ms = length, most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("sessions", "session LONG", KEPT)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        stored = sorted(((k[0], v) for k, v in self.kept.iterator()), key=lambda kv: kv[1][3])
        now = timerValues.getCurrentWatermarkInMs()
        live = OrderedDict((k, (SessionState(self.length, *v[:3]), v[3], v[4])) for k, v in stored if v[4] + self.ttl_ms > now)
        before, touched = {k for k, _ in stored}, set()
        clock = max((used for _, used, _ in live.values()), default=0)
        ordered = in_order(rows)
        while part := list(islice(ordered, CHUNK)):
            seen = []
            for name, seq, ms, call, value, valid, reset in part:
                state, _, last = live.pop(name, (None, 0, ms))
                if state is None:
                    state = SessionState(self.length)
                    if len(live) >= self.most:
                        touched.discard(live.popitem(last=False)[0])
                clock += 1
                live[name] = state, clock, max(last, ms)
                touched.add(name)
                seen.append((name, seq, call, *state.observe(call, value, valid, reset)))
            yield pd.DataFrame(seen, columns=["session", "seq", "call_index", "accepted", "history", "mask", "answer", "source"])
        for name in before - live.keys():
            self.kept.removeKey((name,))
        for name in touched & live.keys():
            state, used, ms = live[name]
            self.kept.updateValue((name,), (state.history, state.last_call, state.last_valid, used, ms))
        self._wake(min(ms for _, _, ms in live.values()), timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        times = {k[0]: v[4] for k, v in self.kept.iterator()}
        now = timerValues.getCurrentWatermarkInMs()
        for name in [k for k, ms in times.items() if ms + self.ttl_ms <= now]:
            self.kept.removeKey((name,))
            del times[name]
        if times:
            self._wake(min(times.values()), timerValues)
        yield from ()

    def _wake(self, oldest: int, timers: TimerValues) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(max(oldest + self.ttl_ms, timers.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


def bounded_session_stream(stream: DataFrame, length: int = 4, most: int = 256, shards: int = 1024, shard: Column | None = None,
                           ttl: str = "1 day", ttl_seconds: int = 86400) -> DataFrame:
    """:func:`session_stream` with at most ``most`` live sessions in each of ``shards`` shards (or per value of the long column ``shard``).

    When a shard is full, its session used longest ago is forgotten: its next request starts a new one. Rows of a shard are taken in ``seq`` order
    within a micro-batch, so a shard's part of a micro-batch is one task; its memory does not grow with the rows (:func:`in_order`). Rows later than
    the watermark are dropped. A session is forgotten once the watermark, ``ttl`` behind the newest event, is ``ttl_seconds`` past its last event. The session's
    ``spark.sql.streaming.stateStore.providerClass`` must be RocksDB (:data:`ROCKS`) when the query starts.
    """
    at = F.pmod(F.xxhash64("session"), F.lit(shards)) if shard is None else shard.cast("long")
    rows = plain_rows(stream, ttl).withColumn("shard", at)
    return rows.groupBy("shard").transformWithStateInPandas(Shard(length, most, ttl_seconds * 1000), OUTPUT, "Append", "EventTime")
