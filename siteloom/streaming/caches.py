"""Answers kept with a time to live, as state of a stream.

A request brings what fetching gave, or null where fetching failed. A kept
answer younger than ``fresh`` is given as it is; else the new one is kept and
given; where fetching failed the kept one is given as stale, until it is
``gone`` old, when a timer drops it. The session needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key string, request_id long, at_ms long, status string, payload string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Answers(StatefulProcessor):
    """The kept answer of one key, and the timer at which it goes."""

    def __init__(self, fresh_ms: int, gone_ms: int) -> None:
        self.fresh_ms, self.gone_ms = fresh_ms, gone_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "payload string, at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        requests = pd.concat(list(rows)).sort_values(["at_ms", "request_id"])
        held = self.kept.get() if self.kept.exists() else None
        before, out = held, []
        for number, at, payload in zip(requests["request_id"], requests["at_ms"], requests["payload"], strict=True):
            if held is not None and at - held[1] >= self.gone_ms:
                held = None
            if held is not None and at - held[1] < self.fresh_ms:
                out.append((number, at, "fresh", held[0]))
            elif payload is not None and payload == payload:
                held = (payload, int(at))
                out.append((number, at, "fetched", payload))
            elif held is not None:
                out.append((number, at, "stale", held[0]))
            else:
                out.append((number, at, "missing", None))
        if held is not None and held != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.kept.update(held)
            self.handle.registerTimer(held[1] + self.gone_ms)
        elif held is None and before is not None:
            self.kept.clear()
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", "request_id", "at_ms", "status", "payload"]).astype({"request_id": "int64", "at_ms": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.kept.exists() and self.kept.get()[1] + self.gone_ms <= at:
            self.kept.clear()
            yield pd.DataFrame({"key": [key[0]], "request_id": [-1], "at_ms": [at], "status": ["gone"], "payload": [None]})

    def close(self) -> None:
        pass


def answered(requests: DataFrame, fresh: int, gone: int, lateness: str = "0 seconds") -> DataFrame:
    """key, request_id, at_ms, status (fresh, fetched, stale, missing, gone) and payload for a stream of requests (key, request_id, ts, payload); ``fresh`` and ``gone`` in seconds."""
    timed = requests.withWatermark("ts", lateness).withColumn("at_ms", F.unix_millis("ts"))
    return timed.groupBy("key").transformWithStateInPandas(statefulProcessor=Answers(fresh * 1000, gone * 1000), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")
