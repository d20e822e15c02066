"""Stateful intake over streams.

The reference semantics is arrival order. Here a micro-batch's rows of a key are taken in event-time order, and rows
that come later than rows already decided are decided on arrival; a watermark bounds the state by an event-time timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def anchored_dedup(events: DataFrame, key: str, at: str, ident: str, window_seconds: int = 900, late: str = "10 minutes") -> DataFrame:
    """key, ident, at, duplicate: as the batch operator, with the kept report's time as state."""
    out = f"{key} {events.schema[key].dataType.simpleString()}, {ident} {events.schema[ident].dataType.simpleString()}, __at double, duplicate boolean"
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6

    def decide(name: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(batches)).sort_values(["__at", ident])
        made = []
        for t in rows["__at"]:
            again = t - kept < window_seconds
            made.append(again)
            kept = kept if again else t
        state.update((kept,))
        state.setTimeoutTimestamp(max(int((kept + window_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows[[key, ident, "__at"]].assign(duplicate=made)

    stamped = events.withWatermark(at, late).withColumn("__at", seconds)
    return stamped.groupBy(key).applyInPandasWithState(decide, out, "kept double", "append", GroupStateTimeout.EventTimeTimeout)


def limited(events: DataFrame, key: str, at: str, ident: str, limit: int = 5, ttl_seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """key, ident, at, allowed: the limiter that each allowed call resets, with count and end as state."""
    out = f"{key} {events.schema[key].dataType.simpleString()}, {ident} {events.schema[ident].dataType.simpleString()}, __at double, allowed boolean"

    def decide(name: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, until = state.get if state.exists else (0, float("-inf"))
        rows = pd.concat(list(batches)).sort_values(["__at", ident])
        made = []
        for t in rows["__at"]:
            count = 0 if t >= until else count
            ok = count < limit
            made.append(ok)
            if ok:
                count, until = count + 1, t + ttl_seconds
        state.update((count, until))
        state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows[[key, ident, "__at"]].assign(allowed=made)

    stamped = events.withWatermark(at, late).withColumn("__at", F.unix_micros(F.col(at).cast("timestamp")) / 1e6)
    return stamped.groupBy(key).applyInPandasWithState(decide, out, "count int, until double", "append", GroupStateTimeout.EventTimeTimeout)
