"""Connected components over a table of links, in DataFrame operations only.

Alternating large-star and small-star steps: every step points nodes at the smallest
node they can see, so that links turn into stars. Minima come from aggregates with a
map-side combine followed by an equi-join, which adaptive execution can split, so that
no node's neighbours ever have to meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stage


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _settled(links: DataFrame) -> bool:
    """True if every u has one v and no v is itself a u."""
    heads = links.groupBy("u").agg(F.count("*").alias("n"), F.max("v").alias("v"))
    if heads.where("n > 1").limit(1).count():
        return False
    return not links.join(links.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()


def components(links: DataFrame, src: str, dst: str) -> DataFrame:
    """node, root for each node that has a link to another one; root is the smallest node of its component.

    Null ends and links of a node to itself are left out; repeated links count once.
    """
    a, b = F.col(src), F.col(dst)
    now = stage(links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        drop(now)
        low = _least(large)
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        drop(large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
