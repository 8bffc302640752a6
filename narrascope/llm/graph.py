"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.common import written


def _star(links: DataFrame) -> DataFrame:
    """One large-star then one small-star step: every node moves below its smallest neighbour.

    Each step groups narrow pairs by node with partial minima, so a node with
    very many links costs partial rows, not one large task.
    """
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    large = (both.filter(F.col("b") > F.col("a")).join(low, "a")
             .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b"))
    lowest = down.groupBy("a").agg(F.min("b").alias("low"))
    rest = down.join(lowest, "a").filter(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    stars = lowest.select("a", F.col("low").alias("b"))
    return rest.union(stars).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable.

    `links` has two columns a and b of one type; loops and repeats do no harm.
    Alternates large-star and small-star until nothing changes; every round is a
    written table, so the plan stays short and a lost executor costs one stage.
    Only two numbers per round come to the driver.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b"))
    current, before = written(pairs.distinct(), "links"), None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        current = written(_star(current), "stars")
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(current.select(F.col("b"), F.col("b")).distinct())
