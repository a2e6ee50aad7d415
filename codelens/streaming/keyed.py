"""Keyed state of the streaming quotas and timeouts (STR-06..08), on
``transformWithState``: one value per key in RocksDB, dropped by an event-time timer
as soon as the watermark has made it irrelevant.  The state therefore holds the
keys of the last window (and the tolerated lateness), not every key ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, as ``transformWithState`` requires; a
    session that names another provider than Spark's default is left as it is."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get(_PROVIDER):
        spark.conf.set(_PROVIDER, ROCKSDB)


def _millis(ts: pd.Series) -> pd.Series:
    return pd.to_datetime(ts).astype("datetime64[ms]").astype("int64")


class _Timed(StatefulProcessor):
    """One value and at most one timer per key."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def expire_at(self, ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ms)

    def forget(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.clear()

    def close(self) -> None:
        pass


class Quota(_Timed):
    """Counts requests in a window that opens at a request; when the watermark passes
    its end, no request can fall into it any more and the key is forgotten."""

    schema = "reset_ms long, count long"

    def __init__(self, max_requests: int, window_ms: int):
        self.max_requests, self.window_ms = max_requests, window_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reset, count = self.state.get() if self.state.exists() else (None, 0)
        # a micro-batch's rows of a key come in any order, the window opens at the earliest
        parts = [p for p in rows if len(p)]
        if not parts:
            return
        ts = pd.concat(parts)["ts"].sort_values(kind="stable")
        counts, resets = [], []
        for t in _millis(ts).tolist():
            if reset is None or t >= reset:
                reset, count = t + self.window_ms, 0
            count += 1
            counts.append(count)
            resets.append(reset)
        self.state.update((int(reset), int(count)))
        self.expire_at(int(reset))
        out = pd.DataFrame({"key": key[0], "ts": ts.values, "count": counts})
        out["remaining"] = (self.max_requests - out["count"]).clip(lower=0)
        out["limited"] = out["count"] > self.max_requests
        out["reset_ts"] = pd.to_datetime(pd.Series(resets, dtype="int64"), unit="ms")
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())


class Timeout(_Timed):
    """Tells once of a key whose last event is ``limit_ms`` behind the watermark and was not terminal."""

    schema = "last_ms long, kind string"

    def __init__(self, limit_ms: int, terminal: list[str]):
        self.limit_ms, self.terminal = limit_ms, terminal

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, kind = self.state.get() if self.state.exists() else (None, None)
        for part in rows:
            if len(part):
                ms = _millis(part["ts"])
                i = int(ms.values.argmax())
                if last is None or int(ms.iloc[i]) >= last:
                    last, kind = int(ms.iloc[i]), str(part["kind"].iloc[i])
        if last is None:
            return iter(())
        if kind in self.terminal:
            self.forget()
        else:
            self.state.update((last, kind))
            self.expire_at(last + self.limit_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _kind = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"id": [key[0]], "last_ts": [pd.Timestamp(last, unit="ms")], "kind": ["timed_out"]})


def keyed(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, watermark: str) -> DataFrame:
    """Rows (key, ts, ...) of a stream through ``processor``, with event time in ``ts``."""
    use_rocksdb(rows.sparkSession)
    marked = rows.where(F.col("ts").isNotNull()).withWatermark("ts", watermark)
    return marked.groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")
