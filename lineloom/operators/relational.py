"""Joins, set operations and orderings with the engine's tie and null rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.sources.shared import shared_path


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the one that comes last. A maximum, not a sort, so partial results shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*").select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*").select(*df.columns)


def join_left_last_wins(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left join where of the right rows of a key only the last counts."""
    return left.join(keep_last(right, keys, order), list(keys), "left")


def join_inner_three(findings: DataFrame, runs: DataFrame, reruns: DataFrame, key: str) -> DataFrame:
    """Findings with their run (dropped without one) and, if there is one, their rerun."""
    return findings.join(runs, key, "inner").join(reruns, key, "left")


def exclude(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in `gone`; rows without a key are kept."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def union_first(first: DataFrame, second: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Both frames, one row a key; the first frame's rows win, then the order."""
    both = first.withColumn("__s", F.lit(0)).unionByName(second.withColumn("__s", F.lit(1)))
    return keep_first(both, keys, ["__s", *order]).drop("__s")


def lookup_first_match(wanted: DataFrame, entries: DataFrame, key: str, order: str, value: str, test: Column, default: str) -> DataFrame:
    """For each wanted key the first entry that passes the test, or the default."""
    first = entries.where(test).groupBy(key).agg(F.min_by(value, order).alias(value))
    return wanted.join(first, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def join_marker(bodies: DataFrame, body: str, pattern: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose body names a key: the marker is extracted and joined by equality, which containment would not allow."""
    marked = bodies.withColumn("__marker", F.explode(F.array_distinct(F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(1)))))
    return marked.join(keys, F.col("__marker") == keys[key], "inner").drop("__marker")


def circular_slice(df: DataFrame, order: str, start: int, size: int, everything: bool = False) -> DataFrame:
    """`size` rows from place `start` of the order, round the end. The order must be a dense index from 0."""
    if everything:
        return df
    n = df.agg((F.max(order) + 1).alias("n"))
    near = df.join(F.broadcast(n))  # one row
    return near.where(F.pmod(F.col(order) - F.lit(start) + F.col("n"), F.col("n")) < size).drop("n")


def range_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, keys: Sequence[str], width: int = 1024) -> DataFrame:
    """Points within half-open spans [low, high) of the same keys. Both go to buckets of `width`, so it is an equi-join."""
    cut = points.withColumn("__b", F.floor(F.col(point) / width))
    spread = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.greatest(F.col(high), F.col(low) + 1) - 1) / width))))
    return cut.join(spread, [*keys, "__b"]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__b")


def asof_backward(points: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """Each point with the value of the last mark at or before it, in one pass over both."""
    both = points.withColumn("__p", F.lit(1)).withColumn(value, F.lit(None).cast(marks.schema[value].dataType)).unionByName(marks.select(*keys, at, value).withColumn("__p", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(at, "__p").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(order)).where("__p = 1").drop("__p")


def self_join_next(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Pairs of rows of the same keys whose numbers follow each other; the least such number of each key."""
    left = df.select(*keys, F.col(number).alias("left"))
    right = df.select(*keys, (F.col(number) - 1).alias("left"), F.col(number).alias("right"))
    return left.join(right, [*keys, "left"]).groupBy(*keys).agg(F.min("left").alias("left"), F.min("right").alias("right"))


def top_k(df: DataFrame, group: str, k: int, collation: str = "UNICODE") -> DataFrame:
    """The k groups of most rows, ties in the order of a dictionary (a collation, then the name's bytes); counts are partial
    before the shuffle and the limit is a heap."""
    return df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.collate(F.col(group), collation), F.asc(group)).limit(k)


def placed(df: DataFrame, order: Sequence[Column], place: str = "place") -> DataFrame:
    """df with each row's place (from 1) in the whole order, which should be total.

    Rows are sorted once, into ranges that are written to the shared folder; a row's place is its place in its range after
    the sizes of the ranges before. Only those sizes, one a range, meet in one task.
    """
    spark = df.sparkSession
    path = shared_path(spark, "ranges")
    ranged = df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("__r"))
    ranged.write.parquet(path)
    kept = spark.read.schema(ranged.schema).parquet(path)
    sizes = kept.groupBy("__r").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"))
    own = F.row_number().over(Window.partitionBy("__r").orderBy(*order))
    return kept.withColumn("__k", own).join(offsets, "__r").withColumn(place, (F.col("__b") + F.col("__k")).cast("long")).drop("__r", "__k", "__b")


def cap_successes(df: DataFrame, keys: Sequence[str], order: Sequence[str], success: Column, cap: int) -> DataFrame:
    """df with `allowed`: rows that would succeed, until `cap` of them did in their order."""
    before = F.sum(success.cast("int")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("allowed", success & (before <= cap))
