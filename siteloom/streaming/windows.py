"""Structured Streaming forms of the service's time-bound behaviour."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def over_limit(events: DataFrame, limit: int, window: str = "60 seconds", lateness: str = "10 minutes") -> DataFrame:
    """user_id and window of the users who go over ``limit`` requests in a fixed window."""
    counts = events.withWatermark("ts", lateness).groupBy("user_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("requests"))
    return counts.where(F.col("requests") > limit).select("user_id", F.col("w.start").alias("start"), "requests")


def once(events: DataFrame, key: str, lateness: str = "10 minutes") -> DataFrame:
    """Events whose key has not been seen within ``lateness``."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def last_samples(events: DataFrame, size: int = 512) -> DataFrame:
    """Nearest-rank median, 95th percentile and maximum of each type's last ``size`` values, as they come in.

    The state of a type is its last ``size`` values and nothing more.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        new = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        held = (held + new["value"].tolist())[-size:]
        state.update((held,))
        ordered = sorted(held)
        rank = lambda q: ordered[max(0, -int(-q * len(ordered) // 1) - 1)]
        yield pd.DataFrame({"event_type": [key[0]], "samples": [len(held)], "p50": [rank(0.5)], "p95": [rank(0.95)], "most": [ordered[-1]]})

    return events.groupBy("event_type").applyInPandasWithState(step, "event_type string, samples long, p50 double, p95 double, most double", "held array<double>", "update", GroupStateTimeout.NoTimeout)


def stale_sources(events: DataFrame, hours: int = 48) -> DataFrame:
    """Types whose newest event is over ``hours`` older than the newest of all; for a batch or a batch of a stream."""
    newest = events.groupBy("event_type").agg(F.max("ts").alias("last"))
    return newest.crossJoin(F.broadcast(newest.agg(F.max("last").alias("now")))).where(F.col("last") < F.col("now") - F.expr(f"INTERVAL {hours} HOURS")).select("event_type", "last")
