"""Stateful processors with typed state, event-time timers and clean-up, on the RocksDB state store.

Rows that come out of order are held until the watermark has passed them and then taken in order, so that the stream
gives what the batch form gives; rows later than the watermark are dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """These processors need this state store; set it before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)


class _InOrder(StatefulProcessor):
    """Holds rows (``event_us``, microseconds of event time, ``event_key``, ``event_value``) and hands them on in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "us long, id long", "value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for frame in rows:
            for us, i, value in zip(frame["event_us"], frame["event_key"], frame["event_value"], strict=True):
                self.held.updateValue((int(us), int(i)), (None if pd.isna(value) else float(value),))
                first = us if first is None else min(first, us)
        if first is not None:
            self.handle.registerTimer(int(first) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((k, v[0]) for k, v in self.held.iterator())
        ready = [((us, i), v) for (us, i), v in rows if us < until]
        for k, _ in ready:
            self.held.removeKey(k)
        if len(rows) > len(ready):
            self.handle.registerTimer(rows[len(ready)][0][0] // 1000 + 1)
        yield from self.take(key, ready)

    def take(self, key: tuple, ready: list) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class CountWindows(_InOrder):
    """Full windows of ``size`` rows: (key, window, n, total)."""

    def __init__(self, by: str, size: int) -> None:
        self.by, self.size = by, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "number long, n long, total double")

    def take(self, key: tuple, ready: list) -> Iterator[pd.DataFrame]:
        number, n, total = self.open.get() if self.open.exists() else (0, 0, 0.0)
        out = []
        for _, value in ready:
            n, total = n + 1, total + (value or 0.0)
            if n == self.size:
                out.append((key[0], number, n, round(total, 6)))
                number, n, total = number + 1, 0, 0.0
        self.open.update((number, n, total))
        if out:
            yield pd.DataFrame(out, columns=[self.by, "window", "n", "total"])


class Regressions(_InOrder):
    """Rows whose value is below that of the row before: (key, id, before, value)."""

    def __init__(self, by: str, key: str) -> None:
        self.by, self.key = by, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "value double")

    def take(self, key: tuple, ready: list) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        out = []
        for (_, i), value in ready:
            if before is not None and value is not None and value < before:
                out.append((key[0], i, before, value))
            before = value
        self.last.update((before,))
        if out:
            yield pd.DataFrame(out, columns=[self.by, self.key, "before", "value"])


class FileStates(StatefulProcessor):
    """Files as repeated scans see them: created, modified (another hash), and deleted once no scan has seen a file for so
    many milliseconds of event time; a deleted file's state is cleared."""

    def __init__(self, missing_ms: int) -> None:
        self.missing_ms = missing_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", "hash string, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.state.get() if self.state.exists() else None
        out = []
        for ms, digest in sorted((int(us) // 1000, h) for frame in rows for us, h in zip(frame["event_us"], frame["hash"], strict=True)):
            if known and ms >= known[1] + self.missing_ms:  # gone before the timer said so
                out.append((key[0], "deleted", _time(known[1] + self.missing_ms)))
                known = None
            if known is None or digest != known[0] and ms >= known[1]:
                out.append((key[0], "created" if known is None else "modified", _time(ms)))
            known = (digest if known is None or ms >= known[1] else known[0], ms if known is None else max(ms, known[1]))
        if known:
            self.state.update(known)
            self.handle.registerTimer(known[1] + self.missing_ms)
        if out:
            yield pd.DataFrame(out, columns=["path", "change", "at"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            _, seen = self.state.get()
            if seen + self.missing_ms <= timerValues.getCurrentWatermarkInMs():
                self.state.clear()
                yield pd.DataFrame([(key[0], "deleted", _time(seen + self.missing_ms))], columns=["path", "change", "at"])

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, by: str, ts: str, key: str, value: str, late: str) -> DataFrame:
    return rows.withWatermark(ts, late).select(by, ts, F.unix_micros(ts).alias("event_us"), F.col(key).cast("long").alias("event_key"), F.col(value).cast("double").alias("event_value"))


def count_windows(rows: DataFrame, by: str, ts: str, key: str, value: str, size: int = 10, late: str = "1 hour") -> DataFrame:
    """The stream of full windows of ``size`` rows, in order of (ts, key), however the rows come within the watermark."""
    kind = rows.schema[by].dataType.simpleString()
    return _in_order(rows, by, ts, key, value, late).groupBy(by).transformWithStateInPandas(CountWindows(by, size), f"{by} {kind}, window long, n long, total double", "Append", "EventTime")


def regressions(rows: DataFrame, by: str, ts: str, key: str, value: str, late: str = "1 hour") -> DataFrame:
    """The stream of rows whose value is below that of the row before it in (ts, key)."""
    kind = rows.schema[by].dataType.simpleString()
    return _in_order(rows, by, ts, key, value, late).groupBy(by).transformWithStateInPandas(Regressions(by, key), f"{by} {kind}, {key} long, before double, value double", "Append", "EventTime")


def file_changes(scans: DataFrame, ts: str = "scanned", missing: int = 600, late: str = "1 minute") -> DataFrame:
    """(path, change, at) of a stream of scans (path, hash, ts): what is created, modified, or missing for so many seconds."""
    rows = scans.withWatermark(ts, late).select("path", "hash", ts, F.unix_micros(ts).alias("event_us"))
    return rows.groupBy("path").transformWithStateInPandas(FileStates(missing * 1000), "path string, change string, at timestamp", "Append", "EventTime")
