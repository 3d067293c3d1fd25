"""Per-call results of a stream in event-time order.

Whether a call is admitted, and how many calls came before it, depends on the
calls before it in time, in whatever micro-batch they arrive.  So calls are
held back in state until the watermark has passed them: a timer at the end of
a key's first held minute hands on, in order of time, the calls of all minutes
that have ended by then.  What is emitted is final; the order of files and the
cut into batches make no difference.  Calls that arrive later than the lateness
allows are dropped by the watermark.

State per key (RocksDB, with a change log): the held calls by hour, the list of
these hours, and the times of the last hour that the next result depends on.
State is asked a few times for each hour of a key, not for each call or minute:
every question is a round trip between Python and the JVM.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE, HOUR = 60_000_000, 3_600_000_000


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB and checkpoint only
    what a batch has changed; the session's own settings come back after."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class _InOrder(StatefulProcessor):
    """Holds calls until event time has passed their minute; subclasses say
    what calls, in order, give."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "hour long", "times array<long>")
        self.hours = handle.getValueState("hours", "hours array<long>")
        self.recent = handle.getValueState("recent", "times array<long>")

    def _wake(self, us: int) -> None:
        """A timer at the end of the minute of ``us``."""
        self.handle.registerTimer((us // MINUTE + 1) * MINUTE // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = np.sort(np.concatenate([pdf["us"].to_numpy() for pdf in rows]))       # 8 bytes a call
        if not len(new):
            return iter([])
        open_hours = set(self.hours.get()[0]) if self.hours.exists() else set()
        starts = np.flatnonzero(np.diff(new // HOUR, prepend=new[0] // HOUR - 1))
        for part in np.split(new, starts[1:]):
            hour, times = int(part[0] // HOUR), part.tolist()
            if hour in open_hours:
                times = [*self.held.getValue((hour,))[0], *times]
            open_hours.add(hour)
            self.held.updateValue((hour,), (times,))
        self.hours.update((sorted(open_hours),))
        self._wake(int(new[0]))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All calls of the minutes that event time has passed, hour by hour."""
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000 // MINUTE * MINUTE
        hours = list(self.hours.get()[0]) if self.hours.exists() else []
        due = [h for h in hours if h * HOUR < until]
        later = hours[len(due):]
        if not due:
            if later:
                self._wake(later[0] * HOUR)
            return
        recent = list(self.recent.get()[0]) if self.recent.exists() else []
        wake = later[0] * HOUR if later else None
        for hour in due:
            times = sorted(self.held.getValue((hour,))[0])
            passed = bisect.bisect_left(times, until)
            if passed < len(times):             # in the last of these hours alone
                self.held.updateValue((hour,), (times[passed:],))
                later, wake = [hour, *later], times[passed]
            else:
                self.held.removeKey((hour,))
            if passed:
                rows, recent = self.results(times[:passed], recent)
                yield pd.DataFrame({"key": [key[0]] * passed, "ts": pd.to_datetime(pd.Series(times[:passed], dtype="int64"), unit="us"), **rows})
        self.recent.update((recent,))
        self.hours.update((later,))
        if wake is not None:
            self._wake(wake)

    def results(self, times: list[int], recent: list[int]) -> tuple[dict, list[int]]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Limiter(_InOrder):
    def __init__(self, per_minute: int, per_hour: int):
        self.per_minute, self.per_hour = per_minute, per_hour

    def results(self, times, recent):
        """``recent``: the admitted calls of the last hour, at most ``per_hour``."""
        ok = []
        for t in times:
            first = bisect.bisect_left(recent, t - HOUR)
            if first:
                recent = recent[first:]
            ok.append(len(recent) - bisect.bisect_left(recent, t - MINUTE) < self.per_minute and len(recent) < self.per_hour)
            if ok[-1]:
                recent.append(t)
        return {"admitted": ok}, recent


class _Rates(_InOrder):
    def results(self, times, recent):
        """``recent``: all calls of the last hour.  Calls of one time count each other."""
        at = np.array(times)
        every = np.concatenate([np.array(recent, dtype="int64"), at])
        upto = np.searchsorted(every, at, "right")
        counts = {name: upto - np.searchsorted(every, at - width) for name, width in (("calls_last_minute", MINUTE), ("calls_last_hour", HOUR))}
        return counts, every[np.searchsorted(every, at[-1] - HOUR):].tolist()


def _keyed(calls: DataFrame, key: str, ts: str, lateness: str):
    time = F.col(ts).cast("timestamp")
    return (calls.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), time.alias("at"), F.unix_micros(time).alias("us"))
            .withWatermark("at", lateness).groupBy("key"))


def admit_calls_in_order(calls: DataFrame, key: str = "agent", ts: str = "ts", per_minute: int = 60, per_hour: int = 1000,
                         lateness: str = "10 minutes") -> DataFrame:
    """The rate limiter over a stream whose calls may come in any order within
    ``lateness``: (key, ts, admitted), as ``operators.costs.admit_calls``
    decides.  Start it within :func:`rocksdb_state`."""
    return _keyed(calls, key, ts, lateness).transformWithStateInPandas(
        _Limiter(per_minute, per_hour), "key string, ts timestamp, admitted boolean", "append", "eventTime")


def call_rates_in_order(calls: DataFrame, key: str = "agent", ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """At each call of a stream, the calls of its key in the last minute and
    hour: (key, ts, calls_last_minute, calls_last_hour), as
    ``operators.costs.call_rate_stats`` counts.  Start it within :func:`rocksdb_state`."""
    return _keyed(calls, key, ts, lateness).transformWithStateInPandas(
        _Rates(), "key string, ts timestamp, calls_last_minute long, calls_last_hour long", "append", "eventTime")
