"""Connected components over a table of links, by alternating large and small stars.

Each round is joins and pre-aggregated minima keyed by node; nothing is gathered on the driver but two numbers that
tell whether the links still change. A hot node meets only a partial minimum and a join whose skewed side adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.llm.common import scratch


def _star(links: DataFrame, smaller: bool) -> DataFrame:
    """links (a, b): each node's neighbours above (large star) or below (small star) it go to the least of them."""
    if smaller:
        sides = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    else:
        sides = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("node", "other")
    least = sides.groupBy("node").agg(F.min("other").alias("low")).select(F.col("node").alias("n"), F.least("node", "low").alias("low"))
    met = sides.join(least, F.col("node") == F.col("n"))
    if smaller:
        moved = met.select(F.col("other").alias("a"), F.col("low").alias("b")).unionAll(least.select(F.col("n").alias("a"), F.col("low").alias("b")))
    else:
        moved = met.where(F.col("other") > F.col("node")).select(F.col("other").alias("a"), F.col("low").alias("b"))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a long, b long) -> (node, root): each node that has a link, with the least node of its component."""
    now = scratch(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(most_rounds):
        now = scratch(_star(_star(now, smaller=False), smaller=True), "stars")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
        state = seen
    raise RuntimeError(f"links still change after {most_rounds} rounds")
