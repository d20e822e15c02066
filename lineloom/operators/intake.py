"""Report intake: limits, anchored deduplication, validation and the retry queue, as batch operators.

A limiter's or deduplicator's state depends on its own earlier decisions, which window functions cannot express; it is
a fold over one key's rows in order of time. Keys are dealt by hash and a key's rows are read as a stream of Arrow
batches sorted by time, with a state of a few numbers, so that a hot key needs time but no memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.functions.text import fingerprint_selection
from lineloom.operators.rules import CATEGORIES, cascade

#: Fixed values.
BODY_LIMIT, ERROR_LOG, ERROR_TEXT = 65_536, 20, 500
DEDUP_SECONDS, QUEUE_DAYS, QUEUE_CAP, ATTEMPTS, BACKOFF = 900, 7, 20, 3, (2, 8, 30)


class ResettingLimit:
    """At most `limit` allowed calls until `ttl` seconds pass after the last allowed one; refused calls reset nothing."""

    def __init__(self, limit: int, ttl: float):
        self.limit, self.ttl, self.count, self.until = limit, ttl, 0, float("-inf")

    def __call__(self, at: float) -> bool:
        if at >= self.until:
            self.count = 0
        if self.count >= self.limit:
            return False
        self.count, self.until = self.count + 1, at + self.ttl
        return True


class SlidingLog:
    """At most `limit` allowed calls in any `window` seconds."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window, self.log = limit, window, deque()

    def __call__(self, at: float) -> bool:
        while self.log and at - self.log[0] >= self.window:
            self.log.popleft()
        if len(self.log) >= self.limit:
            return False
        self.log.append(at)
        return True


class Anchored:
    """True for a first report; a later one within `window` seconds of a kept one is a duplicate and moves nothing."""

    def __init__(self, window: float):
        self.window, self.kept = window, float("-inf")

    def __call__(self, at: float) -> bool:
        if at - self.kept < self.window:
            return False
        self.kept = at
        return True


def fold(df: DataFrame, key: str, order: list[str], seconds: Column, state: Callable[[], Any], out: str) -> DataFrame:
    """df (its key, order columns) with a boolean decided by a fresh state(seconds) for each key, rows in order."""
    rows = df.select(key, *[o for o in order if o != key], seconds.cast("double").alias("__at"))
    ordered = rows.repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, decide = object(), state()
        for batch in batches:
            made = []
            for k, at in zip(batch[key], batch["__at"], strict=True):
                if k != last:
                    last, decide = k, state()
                made.append(decide(at))
            yield batch.drop(columns="__at").assign(**{out: made})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__at")
    return ordered.mapInPandas(run, f"{kinds}, {out} boolean")


def daily_guard(df: DataFrame, day: Column, order: list[str], limit: int = 900) -> DataFrame:
    """df with allowed: the first `limit` (one or more) rows of each UTC day.

    Only the row at the limit is looked for (tasks send their first `limit` rows of a day at most); a day's rows are
    compared with it and never sorted in one task.
    """
    rows = df.withColumn("__day", day)
    place = F.row_number().over(Window.partitionBy("__day").orderBy(*order))
    last = rows.select("__day", F.struct(*order).alias("__last"), place.alias("__n")).where(F.col("__n") == limit).select(F.col("__day").alias("__of"), "__last")
    met = rows.join(last, F.col("__day").eqNullSafe(F.col("__of")), "left")
    return met.withColumn("allowed", F.col("__last").isNull() | (F.struct(*order) <= F.col("__last"))).drop("__day", "__of", "__last")


def report_fingerprint(patent: Column, category: Column, selection: Column) -> Column:
    short = F.substring(F.sha2(fingerprint_selection(selection), 256), 1, 8)
    return F.substring(F.sha2(F.concat_ws("|", patent, category, short), 256), 1, 16)


def validate_report(patent: Column, category: Column, version: Column) -> Column:
    """The first reason to refuse, or null."""
    return cascade(
        [
            (patent.isNull() | (patent == ""), F.lit("Missing required field: patentNumber")),
            (~patent.rlike("^[A-Za-z0-9]{6,20}$"), F.lit("Invalid patentNumber format")),
            (category.isNull() | ~category.isin(*CATEGORIES), F.lit("Invalid category. Must be one of: " + ", ".join(CATEGORIES))),
            (version.isNull() | (version == ""), F.lit("Missing required field: extensionVersion")),
        ],
        F.lit(None),
    )


def build_record(body: Column, at: Column) -> Column:
    """The kept fields of a report; empty text counts as none, numbers only if null."""

    def text(name: str) -> Column:
        return F.nullif(body[name], F.lit(""))

    url = F.coalesce(text("patentUrl"), F.concat(F.lit("https://patents.google.com/patent/US"), body["patentNumber"]))
    log = F.slice(F.coalesce(body["errorLog"], F.array().cast("array<string>")), 1, ERROR_LOG)
    return F.struct(report_fingerprint(body["patentNumber"], body["category"], body["selectionText"]).alias("fingerprint"), at.alias("timestamp"), body["category"].alias("category"), body["patentNumber"].alias("patentNumber"), url.alias("patentUrl"), text("selectionText").alias("selectionText"), text("note").alias("note"), body["scrollY"].alias("scrollY"), log.alias("errorLog"), F.lit(0).alias("duplicate_count"))


def ingest_status(size: Column, allowed: Column, parsed: Column, reason: Column, duplicate: Column) -> Column:
    """The answer's status, cheapest tests first."""
    return cascade([(size > BODY_LIMIT, F.lit(413)), (~allowed, F.lit(429)), (~parsed, F.lit(400)), (reason.isNotNull(), F.lit(400)), (duplicate, F.lit(200))], F.lit(201))


def queue_enqueue(df: DataFrame, key: str, at: str, now: Column, days: int = QUEUE_DAYS, cap: int = QUEUE_CAP) -> DataFrame:
    """Entries younger than `days`, the newest `cap` of each key."""
    live = df.where(F.col(at) > now - F.expr(f"INTERVAL {days} DAY"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), *[F.desc(c) for c in df.columns if c not in (key, at)]))
    return live.withColumn("__r", rank).where(F.col("__r") <= cap).drop("__r")


def queue_retry(status: Column, attempts: Column) -> Column:
    """A struct of outcome and wait seconds; status null is a network error."""
    again = attempts + 1
    drop = status.between(400, 499) & (status != 429)
    wait = cascade([(again == i + 1, F.lit(s)) for i, s in enumerate(BACKOFF)], F.lit(BACKOFF[-1]))
    outcome = cascade([(status.between(200, 299), F.lit("success")), (drop, F.lit("dropped")), (again >= ATTEMPTS, F.lit("dropped"))], F.lit("queued"))
    return F.struct(outcome.alias("outcome"), F.when(outcome == "queued", wait).alias("wait"))


def queue_drain(df: DataFrame, now: Column, enqueued: str, due: str) -> DataFrame:
    return df.where((F.col(enqueued) > now - F.expr(f"INTERVAL {QUEUE_DAYS} DAY")) & (F.col(due) <= now))


def error_ring(messages: Column, prefix: str, size: int = ERROR_LOG) -> Column:
    """The last `size` messages with the prefix, each cut."""
    own = F.transform(F.filter(messages, lambda m: m.startswith(prefix)), lambda m: F.substring(m, 1, ERROR_TEXT))
    return F.slice(own, F.greatest(F.size(own) - size + 1, F.lit(1)), F.lit(size))


def unexpired(df: DataFrame, at: str, now: Column, seconds: int = 7_776_000) -> DataFrame:
    return df.where(F.col(at) > now - F.expr(f"INTERVAL {seconds} SECOND"))
