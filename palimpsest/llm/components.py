"""Connected components of a table of links, without the driver holding any link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the smallest node reachable.

    Alternates large-star and small-star: every round each node hands the smallest node it knows to its
    neighbours, until links are stars around the smallest nodes. The number of rounds grows with the logarithm
    of the longest path. A node with any number of links is a sum over links, never a list. ``links`` are counted first, since a round
    is written to no more files than so many links need.
    """
    most = links.count()
    now = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", most)
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "n")
        # large star: every larger neighbour is linked to the smallest
        large = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour, and the node itself, is linked to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(low, F.col("a") == F.col("n"))
        after = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        after = saved(after, "links", most)
        mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        same = mark(after) == mark(now)
        now = after
        if same:
            break
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
