"""Streams that keep a state of their own for each key: exact rates.

They need Spark's RocksDB state store.  Their queries start with it and leave the session's setting as it was.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructField, StructType

from millrace.streaming.jobs import WATERMARK, stamped, write_rows

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB; a query has its own copy of the settings from its start on."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _Rates(StatefulProcessor):
    """Counts of a group by time, from one period before the watermark on; times behind the watermark are judged once.

    The state is one value: the last time judged, and times and counts as packed 64-bit numbers.
    """

    def __init__(self, by: Sequence[str], max_rows: int, period_us: int):
        self.names, self.max_rows, self.period_us = [*by, "at_us", "at_time", "in_window"], max_rows, period_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "judged long, times binary, counts binary")

    def _load(self) -> tuple[int, np.ndarray, np.ndarray]:
        held = self.ring.get() if self.ring.exists() else None
        if held is None:
            return -(1 << 62), np.empty(0, np.int64), np.empty(0, np.int64)
        return held[0], np.frombuffer(bytes(held[1]), np.int64), np.frombuffer(bytes(held[2]), np.int64)

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-int(micros) // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        judged, times, counts = self._load()
        new: dict[int, int] = {}
        for row in rows:
            new[row["_us"]] = new.get(row["_us"], 0) + 1
        all_times = np.concatenate([times, np.fromiter(new.keys(), np.int64, len(new))])
        times, place = np.unique(all_times, return_inverse=True)
        sums = np.zeros(len(times), np.int64)
        np.add.at(sums, place, np.concatenate([counts, np.fromiter(new.values(), np.int64, len(new))]))
        self.ring.update((judged, times.tobytes(), sums.tobytes()))
        waiting = times[times > judged]
        if len(waiting):
            self._wake(waiting[0])
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        judged, times, counts = self._load()
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        before = np.concatenate([[0], np.cumsum(counts)])
        inside = before[1:] - before[np.searchsorted(times, times - self.period_us)]
        due = (times > judged) & (times <= closed)
        for i in np.flatnonzero(due & (inside > self.max_rows)):
            found = [*key, int(times[i]), int(counts[i]), int(inside[i])]
            yield Row(**dict(zip(self.names, found)))
        # A later time still looks back one period from the watermark.
        stay = times >= closed - self.period_us
        times, counts = times[stay], counts[stay]
        if not len(times):
            self.ring.clear()
            return
        self.ring.update((max(judged, closed), times.tobytes(), counts.tobytes()))
        waiting = times[times > closed]
        # Without any waiting, wake once more to let go of what is left.
        self._wake(waiting[0] if len(waiting) else times[-1] + self.period_us + 1000)

    def close(self) -> None:
        pass


def exact_rates(stream: DataFrame, max_rows: int, period_seconds: int, by: Sequence[str], time: str = "ts",
                watermark: str = WATERMARK) -> DataFrame:
    """Times at which the window ``[t - period, t]`` of a group holds more rows than allowed, as ``rate_audit`` finds them.

    A time is judged when the watermark has passed it, once, by all rows that were not late; so no burst is missed, wherever
    it lies.  Rows without a time are none.  Columns: ``by``, ``at_us`` (microseconds), ``at_time`` (rows at that time) and
    ``in_window``.  The state of a group holds its distinct times from one period before the watermark on, and goes when
    there are none.  A group's rows pass through one task as a stream; pass a group that owns most rows by finer columns.
    Start the query within ``keyed_state``.
    """
    by = list(by)
    counted = stamped(stream.filter(F.col(time).isNotNull()), time, watermark).select(
        *by, time, F.unix_micros(time).alias("_us"))
    fields = [StructField(c, counted.schema[c].dataType) for c in by]
    out = StructType(fields).add("at_us", "long").add("at_time", "long").add("in_window", "long")
    return counted.groupBy(*by).transformWithState(
        _Rates(by, max_rows, period_seconds * 1_000_000), out, "append", "EventTime")


def write_exact_rates(stream: DataFrame, max_rows: int, period_seconds: int, by: Sequence[str], path: str, checkpoint: str,
                      time: str = "ts", watermark: str = WATERMARK, seconds: int | None = None) -> StreamingQuery:
    """Append the alerts of ``exact_rates`` to Parquet."""
    with keyed_state(stream.sparkSession):
        return write_rows(exact_rates(stream, max_rows, period_seconds, by, time, watermark), path, checkpoint, seconds)
