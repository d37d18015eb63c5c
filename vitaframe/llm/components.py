"""Connected components by alternating stars, on tables only.

Each round links every vertex's larger neighbours to its smallest neighbour, then
its smaller ones likewise, until nothing changes. A vertex with very many links is
no burden: its smallest neighbour is found by an aggregate that combines before the
shuffle, and the join back is split where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaframe.llm.common import stage


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """links: u, v with both directions. One half step."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    joined = links.join(least, F.col("u") == F.col("c"))
    if larger:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = joined.filter("v < u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = down.unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def _both(pairs: DataFrame) -> DataFrame:
    there = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    return there.unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """``links``: a, b. Returns node, component for every node with a link."""
    pairs = stage(links.select("a", "b").filter("a != b").distinct(), "links")
    seen = None
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = state
        pairs = stage(_star(_both(pairs), True), "large-star")
        pairs = stage(_star(_both(pairs), False), "small-star")
