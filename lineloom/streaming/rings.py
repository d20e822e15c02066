"""Operators over streams whose state is a list: the log of a sliding limit, and rings of outcomes with a history.

State is kept by transformWithState, which needs the RocksDB state store (`rocksdb(spark)` sets it). As in `intake`, a
micro-batch's rows of a key are taken in order of event time, and rows that come later than rows already decided are decided
on arrival. With `idle_seconds`, which should be no less than the window, the store itself drops a log or history that no row
has renewed for so long by the clock; without it an idle key keeps its few stamps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lineloom.operators.intake import SlidingLog
from lineloom.operators.rules import FLAKE_DAYS, RING

_TIME = T.StructType([T.StructField("at", T.DoubleType())])
_TEXT = T.StructType([T.StructField("value", T.StringType())])


def rocksdb(spark: SparkSession) -> None:
    """Use the state store that list state needs, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _clock(idle_seconds: int | None) -> str:
    return "ProcessingTime" if idle_seconds else "None"


class _Sliding(StatefulProcessor):
    def __init__(self, key: str, ident: str, limit: int, window: float, idle: int | None):
        self.key, self.ident, self.limit, self.window, self.idle = key, ident, limit, window, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", _TIME, ttlDurationMs=self.idle and self.idle * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        decide = SlidingLog(self.limit, self.window)
        decide.log.extend(at for (at,) in self.log.get())
        batch = pd.concat(list(rows)).sort_values(["at_seconds", self.ident])
        allowed = [decide(at) for at in batch["at_seconds"]]
        if decide.log:
            self.log.put([(at,) for at in decide.log])
        else:
            self.log.clear()
        yield batch[[self.key, self.ident, "at_seconds"]].assign(allowed=allowed)

    def close(self) -> None:
        pass


def sliding(events: DataFrame, key: str, at: str, ident: str, limit: int = 5, window_seconds: int = 600, idle_seconds: int | None = None) -> DataFrame:
    """key, ident, at_seconds, allowed: at most `limit` allowed calls of a key in any window; the state is the stamps that count.

    Agrees with the batch fold of `SlidingLog` where a key's rows arrive in order.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, ident)}
    stamped = events.withColumn("at_seconds", F.unix_micros(F.col(at).cast("timestamp")) / 1e6)
    return stamped.groupBy(key).transformWithStateInPandas(_Sliding(key, ident, limit, window_seconds, idle_seconds), f"{key} {kinds[key]}, {ident} {kinds[ident]}, at_seconds double, allowed boolean", "Append", _clock(idle_seconds))


class _Rings(StatefulProcessor):
    def __init__(self, key: str, ident: str, size: int, seconds: float, idle: int | None):
        self.key, self.ident, self.size, self.seconds, self.idle = key, ident, size, seconds, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", _TEXT)
        self.history = handle.getListState("history", _TIME, ttlDurationMs=self.idle and self.idle * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        ring, history = [v for (v,) in self.ring.get()], [at for (at,) in self.history.get()]
        batch = pd.concat(list(rows)).sort_values(["at_seconds", self.ident])
        rings, histories = [], []
        for at, value, flake in zip(batch["at_seconds"], batch["ring_value"], batch["is_flake"], strict=True):
            ring = [*ring, value][-self.size :]
            history = [h for h in [*history, *([at] if flake else [])] if h > at - self.seconds]
            rings.append(ring)
            histories.append(history)
        self.ring.put([(v,) for v in ring])
        if history:
            self.history.put([(h,) for h in history])
        else:
            self.history.clear()
        yield batch[[self.key, self.ident, "at_seconds"]].assign(ring=rings, history=histories)

    def close(self) -> None:
        pass


def _prepared(events: DataFrame, key: str, at: str, ident: str, value: Column, flake: Column) -> DataFrame:
    return events.select(key, ident, (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("at_seconds"), value.alias("ring_value"), F.coalesce(flake, F.lit(False)).alias("is_flake"))


def ring_stream(events: DataFrame, key: str, at: str, ident: str, value: Column, flake: Column, size: int = RING, days: int = FLAKE_DAYS, idle_seconds: int | None = None) -> DataFrame:
    """key, ident, at_seconds, ring, history after every event: the last `size` values, and the times of the flakes (the event's
    own too) of the `days` before it."""
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, ident)}
    schema = f"{key} {kinds[key]}, {ident} {kinds[ident]}, at_seconds double, ring array<string>, history array<double>"
    return _prepared(events, key, at, ident, value, flake).groupBy(key).transformWithStateInPandas(_Rings(key, ident, size, days * 86_400, idle_seconds), schema, "Append", _clock(idle_seconds))


def ring_batch(events: DataFrame, key: str, at: str, ident: str, value: Column, flake: Column, size: int = RING, days: int = FLAKE_DAYS) -> DataFrame:
    """What `ring_stream` gives, over a table: frames of rows and of time instead of state.

    Events of one time count in the order of ident; a history holds those up to its event.
    """
    rows = _prepared(events, key, at, ident, value, flake)
    order = Window.partitionBy(key).orderBy("at_seconds", ident)
    ring = F.collect_list("ring_value").over(order.rowsBetween(1 - size, 0))
    numbered = rows.withColumn("__k", F.row_number().over(order)).withColumn("__mark", F.when(F.col("is_flake"), F.struct("at_seconds", "__k")))
    recent = F.collect_list("__mark").over(Window.partitionBy(key).orderBy("at_seconds").rangeBetween(-days * 86_400, 0))
    own = F.filter(F.col("__recent"), lambda m: (m["__k"] <= F.col("__k")) & (m["at_seconds"] > F.col("at_seconds") - days * 86_400))
    met = numbered.withColumns({"ring": ring, "__recent": recent})
    return met.select(key, ident, "at_seconds", "ring", F.transform(F.array_sort(own), lambda m: m["at_seconds"]).alias("history"))
