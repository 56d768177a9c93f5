"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step groups links by a node, takes the least neighbour and hangs the other neighbours on it; the number of
steps grows with the logarithm of the nodes. A link (u, v), u above v, meets only the least of v's lesser
neighbours, so that the many links of a star's centre pass through a join with a small table, whose skewed partitions
Spark splits; minima are aggregated before they are shuffled, and no node's links are gathered in one place.

Defined results: a link with a null end is none; loops and repeated links change nothing; an empty table gives an empty
one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for every node in a link, the least node reachable. Loops and repeated links are allowed.

    Each round's links are checkpointed; the result reads the last of them.
    """
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = checkpointed(now)
    before = None
    while True:
        # large-star: a node's larger neighbours hang on its least neighbour, or on itself if none is less. The table
        # is checkpointed so that both sides of the join are shuffled by it, which lets Spark split a crowded key.
        least = checkpointed(_least(now)).select(F.col("u").alias("v"), "m")
        large = now.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        # small-star: a node and its smaller neighbours hang on the least of them
        least = _least(large)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        seen = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == before:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        now, before = after, seen
